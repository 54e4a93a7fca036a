"""Small single-machine models of the graph rules, to compare the operators with."""

PROCESS = {"pipeline", "step", "script"}
SOFT = {"documents", "related", "variant"}


def hard(edges):
    return [(s, t) for s, t, r in edges if r not in SOFT and r != "part_of"]


def effective_parents(nodes, edges, node):
    out, todo = set(), [node]
    links = hard(edges)
    while todo:
        here = todo.pop()
        for s, t in links:
            if t == here and s not in out:
                out.add(s)
                if nodes[s]["type"] in PROCESS:
                    todo.append(s)
    return out


def process_outputs(nodes, edges, node):
    out, seen, todo = set(), set(), [node]
    links = hard(edges)
    while todo:
        here = todo.pop()
        for s, t in links:
            if s == here and t not in seen:
                seen.add(t)
                if nodes[t]["type"] in PROCESS:
                    todo.append(t)
                else:
                    out.add(t)
    return out


def link_is_stale(nodes, edges, recorded, edge, placed):
    s, t, r = edge
    now = nodes[s]["current"]
    if now is None or r in SOFT:
        return False
    if r == "part_of":
        return placed.get(edge) is not None and (nodes[s]["final"] or now) != placed[edge]
    targets = process_outputs(nodes, edges, t) if nodes[t]["type"] in PROCESS else {t}
    return any(recorded.get((x, s)) is not None and recorded[(x, s)] != now for x in targets)


def stale(nodes, edges, recorded, placed):
    """Least set of stale nodes: start with nothing and add until nothing changes."""
    out = set()
    while True:
        more = set()
        for n, rec in nodes.items():
            if n in out:
                continue
            into = [e for e in edges if e[1] == n and e[2] not in SOFT]
            if rec["type"] in PROCESS:
                hit = any(link_is_stale(nodes, edges, recorded, e, placed)
                          or (e[0] in out and nodes[e[0]]["type"] not in PROCESS) for e in into)
            else:
                parents = effective_parents(nodes, edges, n)
                hit = any((recorded.get((n, p)) is not None and nodes[p]["current"] is not None
                           and recorded[(n, p)] != nodes[p]["current"])
                          or (nodes[p]["type"] not in PROCESS and p in out) for p in parents)
                hit = hit or any(e[2] == "part_of" and (link_is_stale(nodes, edges, recorded, e, placed) or e[0] in out)
                                 for e in into)
            if hit:
                more.add(n)
        if not more:
            return out
        out |= more


def removal(edges, start):
    gone = set(start)
    names = {x for s, t, _ in edges for x in (s, t)}
    while True:
        more = set()
        for k in names - gone:
            links = [(s, t) for s, t, _ in edges if k in (s, t)]
            others = [t if s == k else s for s, t in links]
            if all(o in gone for o in others) and any(t == k and s in gone for s, t in links):
                more.add(k)
        if not more:
            return gone
        gone |= more
