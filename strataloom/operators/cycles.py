"""Cycle and termination analysis of program graphs, one program per group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PER_COMPONENT = 25
MAX_CYCLES = 100


def strong_components(n: int, after: list[list[int]]) -> list[list[int]]:
    """Tarjan's strong components, without recursion; each sorted, ordered by least member."""
    index, low, on, stack, out = [-1] * n, [0] * n, [False] * n, [], []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, rest = work[-1]
            for w in rest:
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(after[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        members.append(w)
                        if w == v:
                            break
                    out.append(sorted(members))
    return sorted(out)


def simple_cycles(members: list[int], after: list[list[int]], limit: int) -> tuple[list[list[int]], bool]:
    """Simple cycles of one strong component, each from its least node, in lexical order; whether ``limit`` cut them off.

    A depth-first search from each node through greater ones; a node from
    which the start can't be reached by unused nodes is left at once.
    """
    inside, found = set(members), []
    for start in members:
        allowed = {v for v in inside if v >= start}
        path, used = [start], {start}
        work = [iter(sorted(w for w in after[start] if w in allowed))]

        def returns(v: int, allowed=allowed, used=used, start=start) -> bool:
            seen, todo = {v}, [v]
            while todo:
                for w in after[todo.pop()]:
                    if w == start:
                        return True
                    if w in allowed and w not in seen and w not in used:
                        seen.add(w)
                        todo.append(w)
            return False

        while work:
            w = next(work[-1], None)
            if w is None:
                work.pop()
                used.discard(path.pop())
            elif w == start:
                if len(found) == limit:
                    return found, True
                found.append(list(path))
            elif w not in used and returns(w):
                path.append(w)
                used.add(w)
                work.append(iter(sorted(x for x in after[w] if x in allowed)))
    return found, False


def analyse_program(nodes: pd.DataFrame, edges: pd.DataFrame) -> dict:
    """Cycle report of one program: components, cycles, hazards and the verdict."""
    nodes = nodes.sort_values("seq")
    ids = nodes["id"].tolist()
    at = {v: i for i, v in enumerate(ids)}
    after: list[list[int]] = [[] for _ in ids]
    before: list[list[int]] = [[] for _ in ids]
    flow = edges[edges["edge_type"].str.startswith("cfg_")]
    for s, d in sorted({(at[s], at[d]) for s, d in zip(flow["src"], flow["dst"], strict=True) if s in at and d in at}):
        after[s].append(d)
        before[d].append(s)
    kinds, codes = nodes["node_type"].tolist(), nodes["code"].fillna("").tolist()
    ends = [i for i in range(len(ids)) if kinds[i] == "stop" or "STOP RUN" in codes[i].upper()]
    escape, todo = set(ends), list(ends)
    while todo:
        for v in before[todo.pop()]:
            if v not in escape:
                escape.add(v)
                todo.append(v)
    rings = [c for c in strong_components(len(ids), after) if len(c) > 1 or c[0] in after[c[0]]]
    trapped = [c for c in rings if not escape.intersection(c)]
    cycles, cut = [], False
    for c in rings:
        room = min(MAX_PER_COMPONENT, MAX_CYCLES - len(cycles))
        got, more = simple_cycles(c, after, room)
        cycles += got
        cut |= more
    reads, writes = nodes["reads"].tolist(), nodes["writes"].tolist()
    report, recursive, invariant = [], False, False
    for c in cycles:
        calls = any(kinds[i] == "perform" for i in c)
        guards = sorted({v for i in c if kinds[i] == "branch" for v in reads[i]})
        fixed = sorted(set(guards) - {v for i in c for v in writes[i]})
        hazard = bool(guards) and fixed == guards
        recursive |= calls
        invariant |= hazard
        report.append({"nodes": [ids[i] for i in c], "recursive": calls, "guards": guards, "fixed_guards": fixed, "invariant": hazard})
    if trapped or (recursive and invariant):
        verdict = "CRITICAL_INFINITE_LOOP"
    elif recursive:
        verdict = "POTENTIAL_RECURSION"
    else:
        verdict = "ITERATIVE_LOOP" if rings else "DIRECTED_ACYCLIC_FLOW"
    return {
        "n_sccs": len(rings), "n_trapped": len(trapped), "n_cycles": len(cycles), "budget_exhausted": cut, "recursive": recursive,
        "invariant_hazard": invariant, "deadlock": verdict == "CRITICAL_INFINITE_LOOP", "reaches_terminal": bool(ids) and 0 in escape,
        "verdict": verdict, "cycles": report,
    }


CYCLE = "array<struct<nodes:array<string>,recursive:boolean,guards:array<string>,fixed_guards:array<string>,invariant:boolean>>"
REPORT = f"program string, n_sccs int, n_trapped int, n_cycles int, budget_exhausted boolean, recursive boolean, invariant_hazard boolean, deadlock boolean, reaches_terminal boolean, verdict string, cycles {CYCLE}"


def analyse(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cycle report per program.  A program's graph is bounded (one source of limited size), so a group fits a task."""
    n = nodes.select(*[F.col(c).alias(c if c != "program" else "p") for c in ("program", "seq", "id", "node_type", "code", "reads", "writes")])
    e = edges.select(*[F.col(c).alias(c if c != "program" else "q") for c in ("program", "src", "dst", "edge_type")])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"program": key[0], **analyse_program(left, right)}])

    return n.groupBy("p").cogroup(e.groupBy("q")).applyInPandas(run, REPORT)
