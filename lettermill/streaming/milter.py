"""Mail-filter traffic: frames, their parsers, replies, and messages assembled by keyed state."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Commands of the protocol by their byte. Fixed values.
COMMANDS = {
    "A": "Abort", "B": "Body", "C": "Connect", "D": "Macro", "E": "EndBody", "H": "Helo", "L": "Header", "M": "MailFrom",
    "N": "EndHeaders", "O": "OptNeg", "R": "RcptTo", "Q": "Quit", "T": "Data", "U": "Unknown",
}
#: Replies by name. Fixed values.
REPLIES = {"Accept": "a", "Reject": "r", "Discard": "d", "TempFail": "t", "Continue": "c", "AddRecipient": "+", "DeleteRecipient": "-", "AddHeader": "h", "InsertHeader": "i", "ChangeHeader": "m", "CustomReply": "y"}
VERSION, ALL_CALLBACKS = 2, 127
#: Bits of what a filter may do, and of the callbacks it can do without. Fixed values.
ACTIONS = {"AddHeader": 1, "ChangeBody": 2, "AddRecipient": 4, "DeleteRecipient": 8, "ChangeHeader": 16, "Quarantine": 32}
CALLBACKS = {"Connect": 1, "Helo": 2, "MailFrom": 4, "RcptTo": 8, "Body": 16, "Header": 32, "EndHeaders": 64, "Data": 0x200}
FRAME = "conn_id string, seq long, cmd string, payload binary"
MESSAGE = "conn_id string, seq long, raw binary, size long, grey_reject boolean"


def frames(conn_id: str, data: bytes) -> Iterator[tuple[str, int, str, bytes]]:
    """The frames (conn_id, seq, cmd, payload) of a connection's bytes; an incomplete last one ends it."""
    at, seq = 0, 0
    while at + 5 <= len(data):
        size = struct.unpack_from("!I", data, at)[0]
        if size < 1 or at + 4 + size > len(data):
            return
        yield conn_id, seq, data[at + 4 : at + 5].decode("latin-1"), data[at + 5 : at + 4 + size]
        at, seq = at + 4 + size, seq + 1


def decode_frames(connections: DataFrame) -> DataFrame:
    """Frames of recorded connections (conn_id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f for c, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if d is not None for f in frames(c, d)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["conn_id", "seq", "cmd", "payload"])

    return connections.select("conn_id", "data").mapInArrow(run, FRAME)


def _u32(payload: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(payload, at, 4)), 16, 10).cast("long")


def _strings(payload: Column) -> Column:
    """The NUL-terminated strings of a payload."""
    parts = F.split(F.decode(payload, "ISO-8859-1"), "\u0000", -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def parsed(rows: DataFrame) -> DataFrame:
    """Adds name, args (array of strings) and numbers (array of longs) of each frame, as its command has them.

    OptNeg has three numbers; Connect a host, a family and an address, and the port as number; Macro the command it
    precedes and names and values in turn; MailFrom and RcptTo an address without angles and its parameters; Header a name and a
    value; Helo one string; others none. Unknown commands have a null name.
    """
    p, cmd = F.col("payload"), F.col("cmd")
    table = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    text = F.decode(p, "ISO-8859-1")
    host = F.substring_index(text, "\u0000", 1)
    behind = F.length(host) + 2
    # host, NUL, family, and except for family U: two bytes of port, address, NUL
    connect = F.array(host, F.substr(text, behind, F.lit(1)), F.substring_index(F.substr(text, behind + F.when(F.substr(text, behind, F.lit(1)) == "U", 1).otherwise(3)), "\u0000", 1))
    args = (
        F.when(cmd.isin("M", "R"), F.transform(_strings(p), lambda x, i: F.when(i == 0, canonical(x)).otherwise(x)))
        .when(cmd == "L", _strings(p)).when(cmd == "H", F.array(F.rtrim(F.regexp_replace(text, "\u0000$", "")))).when(cmd == "C", connect)
        .when(cmd == "D", F.concat(F.array(F.substr(text, F.lit(1), F.lit(1))), _strings(F.substr(p, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    )
    port = F.conv(F.hex(F.substr(p, behind + 1, F.lit(2))), 16, 10).cast("long")
    numbers = F.when(cmd == "O", F.array(_u32(p, 1), _u32(p, 5), _u32(p, 9))).when(cmd == "C", F.array(port)).otherwise(F.array().cast("array<long>"))
    return rows.withColumns({"name": F.try_element_at(table, cmd), "args": args, "numbers": numbers})


def canonical(address: Column) -> Column:
    """An address without its angles; <> is left alone."""
    return F.when(address == "<>", address).otherwise(F.regexp_replace(address, r"^<+|>+$", ""))


def negotiated(actions: Column, protocol: Column, can: int, skip: int) -> Column:
    """The reply to an OptNeg: the version, and what both sides can do and leave out."""
    return F.struct(F.lit(VERSION).alias("version"), actions.bitwiseAND(F.lit(can)).alias("actions"), protocol.bitwiseAND(F.lit(skip)).alias("protocol"))


def skipped(callbacks: list[str]) -> int:
    """The mask of callbacks a filter does without: all but the ones it has."""
    mask = ALL_CALLBACKS
    for name in callbacks:
        mask &= ~CALLBACKS[name]
    return mask & ALL_CALLBACKS


def reply(cmd: Column, failure: Column | None = None) -> Column:
    """What is answered to a command that has no handler of its own: nothing to Macro and Abort, a close to Quit, else Continue.

    failure is null, or the kind of failure of a handler: TempFail is answered as such, PermFail by Reject.
    """
    if failure is not None:
        return F.when(failure == "TempFail", "TempFail").when(failure == "PermFail", "Reject").otherwise(reply(cmd))
    return F.when(cmd.isin("D", "A"), F.lit(None).cast("string")).when(cmd == "Q", "close").when(cmd == "O", "OptNeg").otherwise("Continue")


def actions(verdict: Column, header: str = "X-Mail-Verdict") -> Column:
    """The actions at a message's end: a header with the verdict, Accept, and the Continue that closes every list."""
    act = lambda a, n=None, v=None: F.struct(F.lit(a).alias("action"), F.lit(n).cast("string").alias("name"), (F.lit(None).cast("string") if v is None else v.cast("string")).alias("value"))
    return F.array(act("AddHeader", header, verdict), act("Accept"), act("Continue"))


def encode_action(action: str, name: str = "", value: str = "", index: int = 0) -> bytes:
    """A reply frame's bytes without the length; Insert- and ChangeHeader carry their index as a number."""
    code = REPLIES[action].encode()
    if action in ("AddHeader",):
        return code + name.encode() + b"\0" + value.encode() + b"\0"
    if action in ("InsertHeader", "ChangeHeader"):
        return code + struct.pack("!I", index) + name.encode() + b"\0" + value.encode() + b"\0"
    if action in ("AddRecipient", "DeleteRecipient"):
        return code + value.encode() + b"\0"
    if action == "OptNeg":
        raise ValueError("use encode_negotiation")
    if action == "CustomReply":
        return code + f"{name} {value}".encode() + b"\0"
    return code


def encode_negotiation(actions_: int, protocol: int, can: int, skip: int) -> bytes:
    """The reply frame's bytes to an OptNeg, without the length."""
    return b"O" + struct.pack("!III", VERSION, actions_ & can, protocol & skip)


def encode_actions(listed: list[tuple[str, str | None, str | None]], can: int = 63) -> bytes:
    """The frames of a list of actions (action, name, value), each with its length. An action that was not negotiated raises; the list is closed by Continue."""
    out = []
    for action, name, value in listed if listed and listed[-1][0] == "Continue" else [*listed, ("Continue", None, None)]:
        need = ACTIONS.get("AddHeader" if action == "InsertHeader" else action)
        if need is not None and not can & need:
            raise ValueError(f"{action} was not negotiated")
        frame = encode_action(action, name or "", value or "")
        out.append(struct.pack("!I", len(frame)) + frame)
    return b"".join(out)


def allowed(action: Column, can: Column) -> Column:
    """Whether the capability that an action needs is among the bits."""
    need = F.when(action.isin("AddHeader", "InsertHeader"), ACTIONS["AddHeader"])
    for name in ("ChangeBody", "AddRecipient", "DeleteRecipient", "ChangeHeader", "Quarantine"):
        need = need.when(action == name, ACTIONS[name])
    return F.coalesce(can.bitwiseAND(need) > 0, F.lit(True))


class Assembly:
    """A connection's message in the making: pieces are kept until its end, and dropped by MailFrom, Abort and Quit."""

    def __init__(self, pieces: list[bytes] | None = None, size: int = 0, grey: bool = False):
        self.pieces, self.size, self.grey = pieces or [], size, grey

    def take(self, seq: int, cmd: str, payload: bytes) -> tuple[int, bytes, int, bool] | None:
        """One frame; the message (seq, raw, body size, grey) at its end. A message that ends without any piece is empty."""
        if cmd in ("M", "A", "Q"):
            self.pieces, self.size, self.grey = [], 0, False
        elif cmd == "L":
            name, _, value = payload.partition(b"\0")
            value = value.rstrip(b"\0")
            self.grey |= name == b"X-Grey-ng" and value.startswith(b"REJECT")
            self.pieces.append(name + b": " + value + b"\n")
        elif cmd == "N":
            self.pieces.append(b"\n")
        elif cmd == "B":
            self.pieces.append(payload)
            self.size += len(payload)
        elif cmd == "E":
            # what was collected stays until the next MailFrom or Abort
            return seq, b"".join(self.pieces), self.size, self.grey
        return None


def assembled(stream: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Messages of a stream of frames; frames of a connection must come in order of seq within each batch and from batch to batch.

    A connection's pieces are kept until MailFrom, Abort or Quit, or until it has been silent for `idle` of processing time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = Assembly()
        if state.exists:
            raw, size, grey = state.get
            held = Assembly([bytes(raw)] if raw else [], size, grey)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for row in rows.itertuples(index=False):
            done = held.take(int(row.seq), row.cmd, bytes(row.payload or b""))
            if done:
                out.append((key[0], *done))
        closed = bool(len(rows)) and rows["cmd"].iloc[-1] == "Q"
        if closed:
            if state.exists:
                state.remove()
        else:
            state.update((b"".join(held.pieces), held.size, held.grey))
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["conn_id", "seq", "raw", "size", "grey_reject"])

    return stream.groupBy("conn_id").applyInPandasWithState(run, MESSAGE, "raw binary, size long, grey boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def assembled_batch(rows: DataFrame) -> DataFrame:
    """The same over recorded frames."""

    def run(table: pa.Table) -> pa.Table:
        held, out = Assembly(), []
        table = table.sort_by("seq")
        conn = table.column("conn_id")[0].as_py()
        for seq, cmd, payload in zip(*(table.column(c).to_pylist() for c in ("seq", "cmd", "payload")), strict=True):
            done = held.take(seq, cmd, payload or b"")
            if done:
                out.append((conn, *done))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("conn_id", "seq", "raw", "size", "grey_reject"), cols, (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()), strict=True)})

    return rows.select("conn_id", "seq", "cmd", "payload").groupBy("conn_id").applyInArrow(run, MESSAGE)


def activity(rows: DataFrame) -> DataFrame:
    """One row (connections, messages, body_bytes): what has passed so far."""
    return rows.agg(F.countDistinct("conn_id").alias("connections"), F.count_if(F.col("cmd") == "E").alias("messages"), F.coalesce(F.sum(F.when(F.col("cmd") == "B", F.length("payload"))), F.lit(0)).alias("body_bytes"))


def start_verdicts(messages: DataFrame, score, sink, checkpoint: str, **trigger):
    """Score a stream of messages batch by batch: score(DataFrame) adds verdict, sink(DataFrame, batch number) stores it with its actions."""

    def handle(batch: DataFrame, number: int) -> None:
        scored = score(batch)
        sink(scored.withColumn("actions", actions(F.col("verdict"))), number)

    return messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def logged_headers(rows: DataFrame) -> DataFrame:
    """Rows (conn_id, seq, header, value) of the two headers that are logged as they pass: X-Grey-ng and From."""
    frames_ = parsed(rows.where("cmd = 'L'"))
    return frames_.select("conn_id", "seq", F.get("args", F.lit(0)).alias("header"), F.try_element_at("args", F.lit(2)).alias("value")).where(F.col("header").isin("X-Grey-ng", "From"))
