"""Cycles: one for each back edge of a depth-first walk, and their canonical form.

The walk is sequential by nature (what it reports depends on its order), so it
runs whole on each repository, in parallel over repositories. Graphs too large
for one task are answered by strong_components() of plans.fixpoint: membership
instead of an enumeration.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(cycle: Column) -> Column:
    """The least rotation of an open cycle's members, NUL-joined: equal for the same cycle from any start."""
    rotated = F.transform(F.sequence(F.lit(0), F.size(cycle) - 1), lambda i: F.array_join(F.concat(F.slice(cycle, i + 1, F.size(cycle)), F.slice(cycle, F.lit(1), i)), "\x00"))
    return F.array_min(rotated)


def walk(nodes: list[str], out: dict[str, list[str]]) -> list[list[str]]:
    """Closed cycles in the order in which a walk from each node in turn meets their back edges."""
    on_path: dict[str, int] = {}
    done, found, seen = set(), [], set()
    for start in nodes:
        if start in done:
            continue
        path, todo = [start], [iter(out.get(start, ()))]
        on_path = {start: 0}
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                gone = path.pop()
                del on_path[gone]
                done.add(gone)
            elif step in on_path:
                members = path[on_path[step] :]
                least = min("\x00".join(members[i:] + members[:i]) for i in range(len(members)))
                if least not in seen:
                    seen.add(least)
                    found.append([*members, step])
            elif step not in done:
                on_path[step] = len(path)
                path.append(step)
                todo.append(iter(out.get(step, ())))
    return found


def find_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, nth, cycle) from nodes(repo_id, path) and edges(repo_id, src, dst)."""
    rows = nodes.select("repo_id", F.col("path").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.select("repo_id", "src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.loc[pdf["dst"].isna(), "src"])
        known = set(names)
        out: dict[str, list[str]] = {}
        for a, b in pdf.loc[pdf["dst"].notna(), ["src", "dst"]].sort_values(["src", "dst"]).itertuples(index=False):
            if a in known and b in known:
                out.setdefault(a, []).append(b)
        got = walk(names, out)
        return pd.DataFrame({"repo_id": pd.Series([pdf["repo_id"].iloc[0]] * len(got), dtype=object), "nth": pd.Series(range(len(got)), dtype="int32"), "cycle": pd.Series(got, dtype=object)})

    return rows.groupBy("repo_id").applyInPandas(run, "repo_id string, nth int, cycle array<string>")


def impacts(nodes: DataFrame, edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """(repo_id, subject, path): all files that import a subject directly or not, without itself; nodes(repo_id, path), edges(repo_id, src, dst), subjects(repo_id, subject).

    A repository with its subjects is one task, as for find_cycles(): a chain of n imports takes n steps there and not n
    rounds of jobs. Memory is that of one repository's edges; graphs beyond one task take graph.impact(), by rounds.
    """
    none = F.lit(None).cast("string")
    rows = (
        nodes.select("repo_id", F.col("path").alias("src"), none.alias("dst"), none.alias("subject"))
        .unionByName(edges.select("repo_id", "src", "dst", none.alias("subject")))
        .unionByName(subjects.select("repo_id", none.alias("src"), none.alias("dst"), "subject"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf.loc[pdf["subject"].notna(), "subject"].unique()
        code, names = pd.factorize(pd.concat((pdf.loc[pdf["subject"].isna(), "src"], pdf.loc[pdf["dst"].notna(), "dst"])))
        lone = pdf.loc[pdf["subject"].isna(), "dst"].isna().to_numpy()
        n = len(lone)
        known = np.zeros(len(names), dtype=bool)
        known[code[:n][lone]] = True
        src, dst = code[:n][~lone], code[n:]
        fine = known[src] & known[dst]
        order = np.argsort(dst[fine], kind="stable")
        importers, bounds = src[fine][order], np.searchsorted(dst[fine][order], np.arange(len(names) + 1))
        place = {name: i for i, name in enumerate(names)}
        found = []
        for subject in asked:
            at = place.get(subject)
            if at is None or not known[at]:
                continue
            seen, todo = {at}, [at]
            while todo:
                i = todo.pop()
                new = set(importers[bounds[i] : bounds[i + 1]].tolist()) - seen
                seen |= new
                todo.extend(new)
            found.append((subject, sorted(names[i] for i in seen - {at})))
        repo = pdf["repo_id"].iloc[0]
        return pd.DataFrame([(repo, subject, p) for subject, paths in found for p in paths], columns=["repo_id", "subject", "path"], dtype=object)

    return rows.groupBy("repo_id").applyInPandas(run, "repo_id string, subject string, path string")
