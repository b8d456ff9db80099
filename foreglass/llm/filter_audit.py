"""What each of several filters removes, in every order they can be applied, by path counting on the subset lattice."""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from foreglass.scale import written_once

BLANKS = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 6  # 720 orders


class Lattice:
    """States are the sets of filters applied so far, as bit masks; an edge applies one more filter.

    ``reach`` counts the orders that lead from no filter to a state, ``leave`` those that
    lead on from it to all filters. An edge lies on ``reach`` of its start times ``leave``
    of its end orders, which is its weight in the filter's Shapley sum.
    """

    def __init__(self, names: list[str]) -> None:
        self.names, self.full = names, (1 << len(names)) - 1
        bits = [1 << i for i in range(len(names))]
        self.reach, self.leave = [0] * (self.full + 1), [0] * (self.full + 1)
        self.reach[0] = self.leave[self.full] = 1
        self.edges: list[tuple[int, int, int]] = []  # filter, start, weight
        for state in range(self.full + 1):  # a subset is a smaller number than any set that holds it
            for bit in bits:
                if state & bit:
                    self.reach[state] += self.reach[state ^ bit]
        for state in range(self.full, -1, -1):
            for bit in bits:
                if not state & bit:
                    self.leave[state] += self.leave[state | bit]
        for i, bit in enumerate(bits):
            self.edges += [(i, s, self.reach[s] * self.leave[s | bit]) for s in range(self.full + 1) if not s & bit]
        self.number = {(i, s): k for k, (i, s, _) in enumerate(self.edges)}

    def paths(self) -> list[dict]:
        """Order, step, filter and edge of every step of every order."""
        out = []
        for order in permutations(range(len(self.names))):
            state = 0
            for step, i in enumerate(order, 1):
                out.append({"filter_order": "".join(self.names[j] for j in order), "step": step, "filter": i, "edge": self.number[i, state]})
                state |= 1 << i
        return out


def _literal(rows: list[dict], ddl: str) -> Column:
    """A constant array of structs."""
    return F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{ddl}>>"))


def copies_of_earlier(docs: DataFrame, id_col: str, text_col: str, carry: Mapping[str, Column]) -> DataFrame:
    """``id``, the carried columns, and ``copy``: some row with a smaller id has the same text.

    Texts are compared by SHA-256 and length, so no text is shuffled; null is the empty
    text. A row of null id is a copy of nothing and nothing is a copy of it. Copies that
    share the smallest id are all firsts. Digests that occur once never reach the join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    columns = [F.col(id_col).alias("id"), F.octet_length(text).alias("bytes"), digest.alias("digest")]
    slim = written_once(docs.select(*columns, *[c.alias(name) for name, c in carry.items()]), "audited")
    firsts = slim.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    firsts = written_once(firsts.filter("c > 1").select("digest", "bytes", "first"), "firsts")
    joined = slim.join(firsts, ["digest", "bytes"], "left")
    return joined.select("id", *carry, F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("copy"))


def audit(rows: DataFrame, part: Column, filters: Mapping[str, Column], marks: Mapping[str, Column]) -> DataFrame:
    """What every filter removes at every step of every order, per part.

    ``filters`` maps a name to the condition under which a row fails it (at most
    ``MOST_FILTERS``), ``marks`` names further conditions whose losses are counted. Rows
    are first counted by part and set of failed filters, with partial sums, so what is
    left is at most 2^filters rows a part however hot the part is. Sums over the lattice
    give the rows that survive each state; the difference along an edge is what its
    filter removes there.

    Returns per part, order and step: ``part, filter_order, step, kept, removed,
    redundant, unique_fails, shapley`` and ``<mark>_lost`` for every mark. Zeros are
    included. A null part or null condition counts as the empty string and as false. No
    rows give no parts.
    """
    names = list(filters)
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    lattice = Lattice(names)
    flag = lambda c: F.coalesce(c, F.lit(False))
    mask = sum((F.when(flag(c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    told = rows.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), *[flag(c).cast("long").alias(f"_{m}") for m, c in marks.items()])
    sums = ["docs", *[f"_{m}" for m in marks]]
    counted = told.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(s).alias(s) for s in sums[1:]])

    # Rows that pass all filters of a state: those whose failures the state does not hold.
    passed = F.filter(F.sequence(F.lit(0), F.lit(lattice.full)), lambda s: s.bitwiseAND(F.col("mask")) == 0)
    alive = counted.select("part", F.explode(passed).alias("state"), *sums).groupBy("part", "state").agg(*[F.sum(s).alias(s) for s in sums])
    there = F.map_from_entries(F.collect_list(F.struct("state", F.struct(*sums))))  # at most 2^filters entries
    states = alive.groupBy("part").agg(there.alias("states"))

    at = lambda state, name: F.coalesce(F.col("states")[state][name], F.lit(0).cast("long"))
    edge = _literal([{"filter": i, "start": s, "end": s | 1 << i, "weight": w} for i, s, w in lattice.edges], "filter:int,start:int,end:int,weight:bigint")
    lost = lambda e: [(at(e["start"], s) - at(e["end"], s)).alias(s) for s in sums]
    edges = F.transform(edge, lambda e: F.struct(e["filter"].alias("filter"), e["weight"].alias("weight"), at(e["end"], "docs").alias("kept"), *lost(e)))
    with_edges = states.select("part", edges.alias("edges"))
    own = lambda i: F.filter("edges", lambda e: e["filter"] == i)
    shapley = [F.aggregate(own(i), F.lit(0).cast("long"), lambda a, e: a + e["weight"] * e["docs"]) for i in range(len(names))]
    full = lambda i: F.col("edges")[lattice.number[i, 0]]["docs"]
    alone = lambda i: F.col("edges")[lattice.number[i, lattice.full ^ 1 << i]]["docs"]
    per_filter = F.array(*[F.struct(shapley[i].alias("shapley"), full(i).alias("fails"), alone(i).alias("alone")) for i in range(len(names))])
    steps = _literal(lattice.paths(), "filter_order:string,step:int,filter:int,edge:int")
    told = with_edges.withColumn("of", per_filter).select("part", "edges", "of", F.explode(steps).alias("at"))
    e, f = F.col("edges")[F.col("at.edge")], F.col("of")[F.col("at.filter")]
    return told.select(
        "part",
        "at.filter_order",
        "at.step",
        e["kept"].alias("kept"),
        e["docs"].alias("removed"),
        (f["fails"] - e["docs"]).alias("redundant"),
        f["alone"].alias("unique_fails"),
        *[e[f"_{m}"].alias(f"{m}_lost") for m in marks],
        f["shapley"].alias("shapley"),
    )


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: few words, few different words, capitals, symbols. Null is empty."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, BLANKS), "")
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(whole),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``audit`` of the four ``text_filters`` and E, copies of a smaller id, with losses of good and toxic documents.

    A document is good or toxic if any row of ``labels`` with its id says so; null ids
    have no label. Other columns of either table are ignored.
    """
    carry = {"part": F.col(part_col).cast("string")} | text_filters(F.col(text_col))
    rows = copies_of_earlier(docs, id_col, text_col, carry)
    told = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = told.filter("id is not null").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    joined = rows.join(marks, "id", "left")
    return audit(joined, F.col("part"), {c: F.col(c) for c in "ABCD"} | {"E": F.col("copy")}, {c: F.col(c) for c in ("good", "toxic")})
