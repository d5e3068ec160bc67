"""First-fit-decreasing packing of documents into containers of fixed capacity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import VOCABULARY, token_count

#: Documents that are packed together by one task.
GROUP_ROWS = 20_000
PLACES = "spec string, group int, container int, doc_id bigint, piece int, first_token bigint, tokens int, at int"


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """``(container, offset)`` of each item, in the order given; items are placed largest first, equal ones in their order.

    A tournament tree over the containers holds the largest free room below each node, so the first container with enough room is found
    going down once. Every size must be at most ``capacity``; items of size 0 go to the first container.
    """
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)
    container, offset = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        s, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < s:
                node += 1
        container[i], offset[i] = node - leaves, capacity - room[node]
        room[node] -= s
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return container, offset


def pieces(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """``(first token, tokens)`` of a document's pieces: one, unless it is longer than a container."""
    if tokens <= capacity:
        return [(0, tokens)]
    return [(a, min(capacity, tokens - a)) for a in range(0, tokens, capacity)]


def pack(docs: DataFrame, specs: DataFrame, size: Column | None = None, group_rows: int = GROUP_ROWS, max_specs: int = 100,
         vocabulary: str = VOCABULARY) -> DataFrame:
    """Where each document lies: one row per spec and piece (columns of PLACES).

    Documents are put into groups by a hash of their id, and each (spec, group) is packed by one task; only ids and sizes move.
    Containers are numbered from 0 within their group. Documents without text have size 0 and are placed too; repeated
    ids are packed as separate items. Specs (a table of a few rows) with a null or non-positive capacity are left out.
    """
    wanted = [(r["spec"], r["capacity"]) for r in specs.where("capacity > 0").select("spec", "capacity").distinct().limit(max_specs + 1).collect()]
    if len(wanted) > max_specs:
        raise ValueError(f"more than {max_specs} pack specs")
    groups = max(1, -(-docs.count() // group_rows))
    sized = docs.select("doc_id", (size if size is not None else token_count(F.col("text"), vocabulary)).alias("tokens"),
                        F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(groups)).cast("int").alias("group"))
    each = F.array(*(F.struct(F.lit(s).cast("string").alias("spec"), F.lit(c).alias("capacity")) for s, c in wanted)) if wanted else \
        F.array().cast("array<struct<spec:string,capacity:int>>")
    items = sized.select("doc_id", "tokens", "group", F.explode(each).alias("s")).select("s.spec", "s.capacity", "group", "doc_id", "tokens")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iat[0])
        rows = [(d, k, a, n) for d, t in sorted(zip(pdf["doc_id"].tolist(), pdf["tokens"].tolist()), key=lambda x: (x[0] is None or x[0] != x[0], x[0]))
                for k, (a, n) in enumerate(pieces(int(t), capacity))]
        container, at = first_fit_decreasing([r[3] for r in rows], capacity)
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "tokens"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["spec"], out["group"], out["container"], out["at"] = pdf["spec"].iat[0], pdf["group"].iat[0], container, at
        return out[["spec", "group", "container", "doc_id", "piece", "first_token", "tokens", "at"]]

    return items.groupBy("spec", "group").applyInPandas(place, PLACES)


def fill_report(places: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers used, the fewest possible by size, tokens and the share of room that is used."""
    used = places.groupBy("spec", "group").agg(F.max("container").alias("last"), F.sum("tokens").alias("tokens")).groupBy("spec").agg(
        F.sum(F.col("last") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    caps = specs.where("capacity > 0").select("spec", "capacity").distinct()
    return used.join(F.broadcast(caps), "spec").select(  # one row per spec
        "spec", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), "tokens",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))
