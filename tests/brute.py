"""Plain Python answers on small graphs, to compare the DataFrame operators with."""

from collections import defaultdict, deque


def neighbours(edges):
    adj = defaultdict(set)
    for a, b in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def bfs(adj, s):
    dist, sigma, order, preds = {s: 0}, defaultdict(float), [], defaultdict(list)
    sigma[s] = 1.0
    todo = deque([s])
    while todo:
        v = todo.popleft()
        order.append(v)
        for w in adj[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
                preds[w].append(v)
    return dist, sigma, order, preds


def betweenness(nodes, edges):
    adj = neighbours(edges)
    node, edge = defaultdict(float), defaultdict(float)
    for s in nodes:
        dist, sigma, order, preds = bfs(adj, s)
        dep = defaultdict(float)
        for w in reversed(order):
            for v in preds[w]:
                c = sigma[v] / sigma[w] * (1 + dep[w])
                dep[v] += c
                edge[tuple(sorted((v, w)))] += c / 2
            if w != s:
                node[w] += dep[w] / 2
    return node, edge


def components(nodes, edges):
    adj, seen, out = neighbours(edges), {}, {}
    for n in sorted(nodes):
        if n in seen:
            continue
        dist = bfs(adj, n)[0]
        for m in dist:
            seen[m] = True
            out[m] = min(dist)
    return out
