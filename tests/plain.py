"""Plain Python versions of the algorithms, for comparison."""

import heapq
from collections import Counter, defaultdict


def bfs(edges, n, source, cap=None):
    out = defaultdict(list)
    for u, v in edges:
        out[u].append(v)
    level = {source: 0} if 0 <= source < n else {}
    queue = list(level)
    for u in queue:
        if cap is not None and level[u] >= cap:
            continue
        for v in out[u]:
            if v not in level and v < n:
                level[v] = level[u] + 1
                queue.append(v)
    return {i: level.get(i) for i in range(n)}


def dijkstra(edges, n, source):
    out = defaultdict(list)
    for u, v, w in edges:
        out[u].append((v, w))
    dist, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, w in out[u]:
            if v not in dist:
                heapq.heappush(heap, (d + w, v))
    return {i: dist.get(i) for i in range(n)}


def pagerank(edges, n, rounds, damping=0.85, tol=0.0):
    deg = Counter(u for u, _ in edges)
    r = [1.0 / n] * n
    for _ in range(rounds):
        loose = sum(r[i] for i in range(n) if not deg[i])
        new = [(1 - damping) / n + damping * loose / n] * n
        for u, v in edges:
            new[v] += damping * r[u] / deg[u]
        moved = sum(abs(a - b) for a, b in zip(r, new))
        r = new
        if moved < tol:
            break
    return dict(enumerate(r))


def labels(edges, n, seeds, rounds):
    lab = {i: seeds.get(i) if seeds is not None else i for i in range(n)}
    out = defaultdict(list)
    for u, v in edges:
        out[u].append(v)
    for k in range(1, rounds + 1):
        new = dict(lab)
        for u in range(n):
            if seeds is not None and u in seeds:
                continue
            c = Counter(lab[v] for v in out[u] if lab[v] is not None)
            if c:
                new[u] = min(c, key=lambda x: (-c[x], x))
        if new == lab:
            return lab, k, True
        lab = new
    return lab, rounds, False


def components(edges, ids=()):
    root = {i: i for i in ids}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in list(root)}
