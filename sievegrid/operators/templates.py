"""Chains of structures matched one to one with chains of their templates.

Only chains that share k-mers on one diagonal are compared; the best matching is found per structure
and template over the scores of these pairs, and only the matching comes out. The letters travel to their
structure and k-mers are made there, since they are many times larger.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.functions.alignment import Substitutions, pair_scores, ungapped_spans
from sievegrid.session import durable, rebalance, release

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("query_st", "query_en", "template_st", "template_en")]))


def best_matching(weights: Mapping[tuple[int, int], int]) -> dict[int, int]:
    """The one-to-one matching of largest total weight over the given pairs, by an auction with shrinking steps.

    Weights are whole and positive; pairs that aren't given can't match, and anyone may stay alone. For that
    every row has a spare column and every column a spare row of weight 0, and the spares of a pair may
    match each other: then all have a partner, as the shrinking steps need.
    """
    rows, cols = sorted({r for r, _ in weights}), sorted({c for _, c in weights})
    n = len(rows) + len(cols)
    if not n:
        return {}
    row_at, col_at = {r: i for i, r in enumerate(rows)}, {c: i for i, c in enumerate(cols)}
    offers: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for (r, c), w in weights.items():
        i, j = row_at[r], col_at[c]
        offers[i].append((j, w * (n + 1)))
        offers[len(rows) + j].append((len(cols) + i, 0))
    for i in range(len(rows)):
        offers[i].append((len(cols) + i, 0))
    for j in range(len(cols)):
        offers[len(rows) + j].append((j, 0))
    prices = [0] * n
    step = max(1, max(weights.values()) * (n + 1) // 4)
    while True:
        owner, has = [-1] * n, [-1] * n
        free = deque(range(n))
        while free:
            bidder = free.popleft()
            first = second = None
            for item, worth in offers[bidder]:
                gain = worth - prices[item]
                if first is None or gain > first[0]:
                    first, second = (gain, item), first
                elif second is None or gain > second[0]:
                    second = (gain, item)
            raise_by = step + (first[0] - second[0] if second else 0)
            item = first[1]
            prices[item] += raise_by
            if owner[item] >= 0:
                has[owner[item]] = -1
                free.append(owner[item])
            owner[item], has[bidder] = bidder, item
        if step == 1:
            break
        step = max(1, step // 5)
    return {r: cols[has[i]] for i, r in enumerate(rows) if has[i] < len(cols)}


def _seeds(k: int, min_seeds: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of the chains and the template chains of one structure: their seeded pairs with the letters of both.

    Rows of one key add up, and each of them comes out with each of the other's.
    """

    def places(text: str | None) -> dict[str, int]:
        first: dict[str, int] = {}
        for i in range(len(text or "") - k + 1):
            first.setdefault(text[i : i + k], i)
        return first

    def rows_of(table: pa.Table, *names: str) -> dict[tuple, list[int]]:
        rows: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in names))):
            rows.setdefault(key, []).append(i)
        return rows

    def find(chains: pa.Table, templates: pa.Table) -> pa.Table:
        mine, theirs = rows_of(chains, "chain_id"), rows_of(templates, "template_id", "template_chain")
        texts, others = chains.column("seq").to_pylist(), templates.column("seq").to_pylist()
        # a line: the number of the chain and how far the k-mer stands behind its place in the template, in one number
        at: dict[str, list[int]] = defaultdict(list)
        for c, rows in enumerate(mine.values()):
            for i in rows:
                for w, place in places(texts[i]).items():
                    at[w].append((c << 40) + (1 << 39) + place)
        left, right, seeds = [], [], []
        held = list(mine.values())
        for rows in theirs.values() if at else ():
            lines: dict[int, int] = defaultdict(int)
            for j in rows:
                for w, place in places(others[j]).items():
                    for x in at.get(w, ()):
                        lines[x - place] += 1
            best: dict[int, int] = {}
            for line, n in lines.items():
                if n >= min_seeds:
                    best[line >> 40] = max(n, best.get(line >> 40, 0))
            for c, n in best.items():
                for i in held[c]:
                    left += [i] * len(rows)
                    right += rows
                    seeds += [n] * len(rows)
        a, b = chains.take(pa.array(left, pa.int64())), templates.take(pa.array(right, pa.int64()))
        return pa.table(
            {
                "structure_id": a.column("structure_id"),
                "template_id": b.column("template_id"),
                "chain_id": a.column("chain_id"),
                "template_chain": b.column("template_chain"),
                "seeds": pa.array(seeds, pa.int64()),
                "_a": a.column("seq"),
                "_b": b.column("seq"),
            }
        )

    return find


def _seeded(chains: DataFrame, templates: DataFrame, k: int, min_seeds: int) -> DataFrame:
    """``seeded_pairs`` with the letters of both. One task holds the letters and k-mers of a structure and its templates."""
    left = chains.select("structure_id", "chain_id", F.col("seq").cast("string").alias("seq")).filter("structure_id IS NOT NULL")
    right = templates.select("structure_id", "template_id", "template_chain", F.col("seq").cast("string").alias("seq"))
    right = right.filter("structure_id IS NOT NULL")
    kinds = dict([*right.dtypes, *left.dtypes])
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("structure_id", "template_id", "chain_id", "template_chain"))
    met = left.groupBy("structure_id").cogroup(right.groupBy("structure_id"))
    return met.applyInArrow(_seeds(k, min_seeds), f"{schema}, seeds bigint, _a string, _b string")


def seeded_pairs(chains: DataFrame, templates: DataFrame, k: int = 5, min_seeds: int = 3) -> DataFrame:
    """(structure_id, template_id, chain_id, template_chain, seeds): chains with ``min_seeds`` k-mers on one diagonal.

    A k-mer counts where it first stands in a chain, so repeats add nothing.
    """
    return _seeded(chains, templates, k, min_seeds).drop("_a", "_b").distinct()


def matched(scored: DataFrame) -> DataFrame:
    """The best one-to-one matching per (structure_id, template_id) of pairs (chain_id, template_chain, score).

    Pairs that score 0 or less don't match. One task holds the scored pairs of a structure and template.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(pdf["chain_id"])), sorted(set(pdf["template_chain"]))
        at, of = {r: i for i, r in enumerate(rows)}, {c: i for i, c in enumerate(cols)}
        # sorted, so that of matchings of one total the same is found however the rows arrive
        score = {(r, c): s for r, c, s in sorted((at[r], of[c], int(s)) for r, c, s in zip(pdf["chain_id"], pdf["template_chain"], pdf["score"]))}
        found = sorted(best_matching(score).items())
        return pd.DataFrame(
            {
                "structure_id": [pdf["structure_id"].iloc[0]] * len(found),
                "template_id": [pdf["template_id"].iloc[0]] * len(found),
                "chain_id": [rows[r] for r, _ in found],
                "template_chain": [cols[c] for _, c in found],
                "score": [score[f] for f in found],
            }
        )

    kept = scored.filter("score > 0").select(
        "structure_id", "template_id", "chain_id", "template_chain", F.round("score").cast("long").alias("score")
    )
    by = "structure_id", "template_id"
    return rebalance(kept, *by).groupBy(*by).applyInPandas(match, kept.schema)


def with_spans(pairs: DataFrame, chains: DataFrame, templates: DataFrame, pair_score: Mapping[tuple[str, str], float]) -> DataFrame:
    """``pairs`` (structure_id, template_id, chain_id, template_chain, ...), a matching found here or given, with
    ``spans``: the best local alignments without gaps."""
    table = Substitutions(pair_score)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([
                [dict(zip(("query_st", "query_en", "template_st", "template_en"), s)) for s in ungapped_spans(x or "", y or "", table)]
                for x, y in zip(a, b)
            ])

    full = rebalance(_with_letters(pairs, chains, templates))
    return full.withColumn("spans", spans("_a", "_b")).drop("_a", "_b")


def _with_letters(pairs: DataFrame, chains: DataFrame, templates: DataFrame) -> DataFrame:
    a = chains.select("structure_id", "chain_id", F.col("seq").alias("_a"))
    b = templates.select("structure_id", "template_id", "template_chain", F.col("seq").alias("_b"))
    return pairs.join(a, ["structure_id", "chain_id"]).join(b, ["structure_id", "template_id", "template_chain"])


def template_match(
    chains: DataFrame,
    templates: DataFrame,
    pair_score: Mapping[tuple[str, str], float],
    k: int = 5,
    min_seeds: int = 3,
    open_gap: float = -11.0,
    extend_gap: float = -1.0,
) -> DataFrame:
    """(structure_id, template_id, chain_id, template_chain, score, spans): each chain's partner in each template.

    ``chains`` has structure_id, chain_id and seq, ``templates`` structure_id, template_id, template_chain and seq, keys
    given once. The matching has the largest total of global alignment scores (whole numbers) that
    seeded pairs allow; a chain without seeds in a template, or without letters, has no partner there.
    """
    pairs = _seeded(chains, templates, k, min_seeds).dropna(subset=["template_id", "chain_id", "template_chain"])
    scored = rebalance(pairs).withColumn("score", pair_scores(pair_score, open_gap, extend_gap)("_a", "_b")).drop("_a", "_b")
    best = durable(matched(scored))
    del pairs, scored
    release(chains.sparkSession)
    return with_spans(best, chains, templates, pair_score)
