"""Two-label minimum cuts of small graphs."""

from __future__ import annotations

from collections import deque


def label(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cut: node i costs max(0, -unary[i]) if labelled true and max(0, unary[i]) if
    false, and each edge (i, j, w) costs w if its ends differ. Nodes that the cut leaves free are false.

    A node whose own cost outweighs all its edges is settled beforehand; the rest is found by augmenting
    shortest paths (the source side of a maximum flow).
    """
    n = len(unary)
    touching = [0.0] * n
    for i, j, w in edges:
        touching[i] += w
        touching[j] += w
    fixed: list[bool | None] = [(u > 0) if abs(u) > t or t == 0 else None for u, t in zip(unary, touching, strict=True)]
    free = [i for i in range(n) if fixed[i] is None]
    if not free:
        return [bool(f) for f in fixed]
    number = {node: k for k, node in enumerate(free)}
    source, sink = len(free), len(free) + 1
    graph: list[dict[int, float]] = [{} for _ in range(len(free) + 2)]

    def add(a: int, b: int, w: float, back: float = 0.0) -> None:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + back

    for node, k in number.items():
        if unary[node] > 0:
            add(source, k, unary[node])
        elif unary[node] < 0:
            add(k, sink, -unary[node])
    for i, j, w in edges:
        a, b = fixed[i], fixed[j]
        if a is None and b is None:
            add(number[i], number[j], w, w)
        elif a is None or b is None:
            k, side = (number[i], b) if a is None else (number[j], a)
            if side:
                add(source, k, w)
            else:
                add(k, sink, w)
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, w in graph[a].items():
                if w > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return [number[i] in came if fixed[i] is None else bool(fixed[i]) for i in range(n)]
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        least = min(graph[a][b] for a, b in path)
        for a, b in path:
            graph[a][b] -= least
            graph[b][a] = graph[b].get(a, 0.0) + least
