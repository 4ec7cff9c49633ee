"""A mail filter that listens: a streaming source of the frames that mail servers send, which answers them."""

from __future__ import annotations

import os
import socketserver
import struct
import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from . import milter

#: Bytes of one frame at most; mail servers send bodies in chunks of 64 KB.
FRAME_BYTES = 16 << 20


class MilterSource(DataSource):
    """Streaming source 'milter' with the rows (conn_id, seq, cmd, payload) of lettermill.streaming.milter.FRAME.

    Options: host (127.0.0.1), port (1080), spool (a folder in which answers to EndBody are put by answer()), hold (seconds
    that an EndBody waits for its answer, 10; without one it is answered by Continue), can and skip (bits offered to OptNeg).
    The listener runs beside the driver; a connection is a thread. Frames are kept until the query has committed them. What
    has not been committed when the driver is lost comes again with the mail server's next try, as its connection breaks.
    """

    @classmethod
    def name(cls) -> str:
        return "milter"

    def schema(self) -> str:
        return milter.FRAME

    def simpleStreamReader(self, schema):
        return _Reader(dict(self.options))


def place(spool: str, conn_id: str, seq: int) -> str:
    return os.path.join(spool, f"{conn_id.replace(':', '_')}-{seq}.reply")


def answer(batch: DataFrame, spool: str) -> None:
    """Put the actions of each message (conn_id, seq, actions) where its connection waits for them."""
    for row in batch.select("conn_id", "seq", "actions").toLocalIterator():
        path = place(spool, row.conn_id, row.seq)
        with open(path + ".tmp", "wb") as out:
            out.write(milter.encode_actions([tuple(a) for a in row.actions]))
        os.replace(path + ".tmp", path)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.frames: list[tuple[str, int, str, bytes]] = []
        self.base, self.lock, self.server = 0, threading.Lock(), None

    def __getstate__(self) -> dict:
        """Copies that Spark sends about know the options only; the listener stays where it is."""
        return {"options": self.options}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["options"])

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.server is None:
            self.base = start["frames"]
            self._listen()
        with self.lock:
            rows = self.frames[start["frames"] - self.base :]
            return iter(rows), {"frames": self.base + len(self.frames)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with self.lock:
            return iter(self.frames[max(0, start["frames"] - self.base) : max(0, end["frames"] - self.base)])

    def commit(self, end: dict) -> None:
        with self.lock:
            done = max(0, end["frames"] - self.base)
            self.frames = self.frames[done:]
            self.base += done

    def _listen(self) -> None:
        reader, options = self, self.options
        numbers = iter(range(1 << 62))

        class Connection(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                conn_id, seq = f"{self.client_address[0]}:{self.client_address[1]}-{os.getpid()}-{next(numbers)}", 0
                while len(head := self.rfile.read(4)) == 4:
                    size = struct.unpack("!I", head)[0]
                    data = self.rfile.read(size) if 0 < size <= FRAME_BYTES else b""
                    if not data or len(data) < size:
                        break
                    cmd = data[:1].decode("latin-1")
                    with reader.lock:
                        reader.frames.append((conn_id, seq, cmd, data[1:]))
                    if cmd == "Q":
                        break
                    self.wfile.write(reader.answer(conn_id, seq, cmd, data[1:]))
                    seq += 1

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self.server = Server((options.get("host", "127.0.0.1"), int(options.get("port", 1080))), Connection)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def answer(self, conn_id: str, seq: int, cmd: str, payload: bytes) -> bytes:
        """The framed answer to a command."""
        framed = lambda data: struct.pack("!I", len(data)) + data
        if cmd in ("D", "A"):
            return b""
        if cmd == "O" and len(payload) >= 12:
            _, actions, protocol = struct.unpack("!III", payload[:12])
            return framed(milter.encode_negotiation(actions, protocol, int(self.options.get("can", 1)), int(self.options.get("skip", 0))))
        if cmd == "E" and self.options.get("spool"):
            path, until = place(self.options["spool"], conn_id, seq), time.monotonic() + float(self.options.get("hold", 10))
            while time.monotonic() < until:
                if os.path.exists(path):
                    with open(path, "rb") as found:
                        data = found.read()
                    os.remove(path)
                    return data
                time.sleep(0.02)
        return framed(milter.encode_action("Continue"))


def listen(spark, **options: str) -> DataFrame:
    """The stream of frames of all connections; options as for MilterSource."""
    spark.dataSource.register(MilterSource)
    return spark.readStream.format("milter").options(**options).load()
