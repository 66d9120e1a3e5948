"""Structure tables: subsets with renumbered indexes, concatenation, tokens, name checks.

Tables are keyed by structure_id. atoms: atom_idx, chain_id, res_idx, ...;
chains: chain_id, entity_id, valid, ...; bonds: atom_1, atom_2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.operators.ordering import RangeOrdered
from sievegrid.session import durable


def atom_name_width_ok(atoms: DataFrame, mol: str, width: int = 4) -> DataFrame:
    """Every upper-case symbol with its 1-based rank fits the width."""
    name = F.concat(F.upper("symbol"), (F.col("rank") + 1).cast("string"))
    return atoms.groupBy(mol).agg((F.max(F.length(name)) <= width).alias("ok"))


def renumber(df: DataFrame, by: str, order: str | Sequence[str], name: str) -> DataFrame:
    """``name``: 0-based dense index of the rows of a structure, in the old order."""
    keys = [order] if isinstance(order, str) else list(order)
    placed = RangeOrdered(df, [by], keys).row_number(name)
    return placed.withColumn(name, F.col(name) - 1)


def _map_ends(links: DataFrame, numbers: DataFrame, index: str, ends: Sequence[str]) -> DataFrame:
    """Replace old indexes by new ones; a link with a lost end goes away."""
    for end in ends:
        side = numbers.select("structure_id", F.col(index).alias(end), F.col("_new").alias("_to"))
        links = links.join(side, ["structure_id", end]).drop(end).withColumnRenamed("_to", end)
    return links


def drop_invalid_chains(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Structures without their invalid chains, all indexes dense again.

    Chains get new ids and, within an entity, new symmetry ids; atoms and
    residues are renumbered; bonds and connections stay when both ends do.
    """
    live = tables["chains"].filter("valid")
    numbered = durable(renumber(live, "structure_id", "chain_id", "_new"))
    chains = RangeOrdered(numbered, ["structure_id", "entity_id"], ["chain_id"]).row_number("_sym")
    chains = chains.withColumn("sym_id", F.col("_sym") - 1).drop("_sym")
    chain_map = numbered.select("structure_id", "chain_id", F.col("_new").alias("_chain"))
    out = {"chains": chains.drop("chain_id").withColumnRenamed("_new", "chain_id")}
    for name, index in (("residues", "res_idx"), ("atoms", "atom_idx")):
        kept = tables[name].join(chain_map, ["structure_id", "chain_id"])
        kept = durable(renumber(kept, "structure_id", ["_chain", index], "_new"))
        if name == "residues":
            res_map = kept.select("structure_id", F.col("res_idx"), F.col("_new").alias("_res"))
            out[name] = kept.drop("chain_id", "res_idx").withColumnsRenamed({"_chain": "chain_id", "_new": "res_idx"})
        else:
            atom_map = kept.select("structure_id", "atom_idx", "_new")
            moved = kept.join(res_map, ["structure_id", "res_idx"])
            out[name] = moved.drop("chain_id", "res_idx", "atom_idx").withColumnsRenamed(
                {"_chain": "chain_id", "_res": "res_idx", "_new": "atom_idx"}
            )
    for name in ("bonds", "connections"):
        if name in tables:
            out[name] = _map_ends(tables[name], atom_map, "atom_idx", ("atom_1", "atom_2"))
    return out


def extract_atoms(tables: Mapping[str, DataFrame], wanted: DataFrame) -> dict[str, DataFrame]:
    """The wanted (structure_id, atom_idx) with dense new indexes, and the bonds among them."""
    kept = tables["atoms"].join(wanted, ["structure_id", "atom_idx"], "left_semi")
    numbered = durable(renumber(kept, "structure_id", "atom_idx", "_new"))
    bonds = _map_ends(tables["bonds"], numbered, "atom_idx", ("atom_1", "atom_2"))
    return {"atoms": numbered.drop("atom_idx").withColumnRenamed("_new", "atom_idx"), "bonds": bonds}


def concatenate(first: Mapping[str, DataFrame], second: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Second structure appended to the first of the same id, its indexes shifted."""
    sizes = first["atoms"].groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("_atoms"), (F.max("chain_id") + 1).alias("_chains"), (F.max("res_idx") + 1).alias("_res")
    )
    shift = lambda c, s: (F.col(c) + F.coalesce(s, F.lit(0))).alias(c)
    moved = second["atoms"].join(sizes, "structure_id", "left")
    offsets = {"atom_idx": "_atoms", "chain_id": "_chains", "res_idx": "_res"}
    atoms = moved.select(
        *[shift(c, offsets[c]) if c in offsets else F.col(c) for c in second["atoms"].columns]
    )
    bonds = second["bonds"].join(sizes, "structure_id", "left").select(
        *[shift(c, "_atoms") if c in ("atom_1", "atom_2") else F.col(c) for c in second["bonds"].columns]
    )
    return {"atoms": first["atoms"].unionByName(atoms), "bonds": first["bonds"].unionByName(bonds)}


def token_table(residues: DataFrame, atoms: DataFrame, chains: DataFrame) -> DataFrame:
    """One token per standard residue, one per atom of any other; valid chains only.

    ``residues``: res_idx, chain_id, is_standard, is_present, center_idx;
    ``atoms``: atom_idx, res_idx, chain_id, is_present, x, y, z. A token is
    resolved when its residue and its centre atom are present.
    """
    keys = ["structure_id", "chain_id"]
    live = residues.join(chains.filter("valid").select(*keys), keys, "left_semi")
    spans = atoms.groupBy("structure_id", "res_idx").agg(
        F.min("atom_idx").alias("atom_idx"), F.count(F.lit(1)).alias("atom_num")
    )
    place = atoms.select(
        "structure_id", F.col("atom_idx").alias("center_idx"), F.col("is_present").alias("_seen"), "x", "y", "z"
    )
    columns = ["structure_id", "chain_id", "res_idx", "atom_idx", "atom_num", "resolved", "x", "y", "z"]
    resolved = (F.col("is_present") & F.col("_seen")).alias("resolved")
    standard = (
        live.filter("is_standard")
        .join(spans, ["structure_id", "res_idx"])
        .join(place, ["structure_id", "center_idx"])
        .withColumn("resolved", resolved)
        .select(*columns)
    )
    single = (
        live.filter("NOT is_standard")
        .select("structure_id", "chain_id", "res_idx", "is_present")
        .join(atoms.select("structure_id", "res_idx", "atom_idx"), ["structure_id", "res_idx"])
        .join(place.withColumnRenamed("center_idx", "atom_idx"), ["structure_id", "atom_idx"])
        .withColumns({"resolved": resolved, "atom_num": F.lit(1).cast("bigint")})
        .select(*columns)
    )
    return renumber(standard.unionByName(single), "structure_id", ["chain_id", "atom_idx"], "token_idx")


def token_bonds(tokens: DataFrame, links: Sequence[DataFrame]) -> DataFrame:
    """Bonds and connections between atoms as bonds between their tokens."""
    of_atom = tokens.select(
        "structure_id", "token_idx", F.explode(F.sequence(F.col("atom_idx"), F.col("atom_idx") + F.col("atom_num") - 1)).alias("a")
    )
    every = links[0].select("structure_id", "atom_1", "atom_2")
    for more in links[1:]:
        every = every.unionByName(more.select("structure_id", "atom_1", "atom_2"))
    side = lambda i: of_atom.select("structure_id", F.col("a").alias(f"atom_{i}"), F.col("token_idx").alias(f"token_{i}"))
    joined = every.join(side(1), ["structure_id", "atom_1"]).join(side(2), ["structure_id", "atom_2"])
    return joined.select("structure_id", "token_1", "token_2")


def region_alignment(regions: DataFrame) -> DataFrame:
    """(chain, row): residues of numbered positions, gaps where a chain has none.

    ``regions``: chain, pos (number and optional insertion letter), aa. The
    positions in use are few (a numbering scheme), their order is natural.
    """
    number = F.regexp_extract("pos", r"(\d+)", 1).cast("int")
    extra = F.regexp_extract("pos", r"\d+([A-Z]*)$", 1)
    keyed = regions.select("chain", F.struct(number.alias("n"), extra.alias("i")).alias("p"), "aa")
    used = keyed.agg(F.array_sort(F.collect_set("p"))).scalar()  # the scheme's positions
    maps = keyed.groupBy("chain").agg(F.map_from_entries(F.collect_list(F.struct("p", "aa"))).alias("m"))
    joined = maps.withColumn("used", used)
    row = F.array_join(F.transform("used", lambda p: F.coalesce(F.col("m")[p], F.lit("-"))), "")
    return joined.select("chain", row.alias("row"))


def map_with_errors(
    df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Run a pandas step per batch; a failing row keeps its message instead of ending the job.

    The step sees whole batches; only a batch that fails is tried row by row.
    ``schema`` is the result of the step, to which ``error string`` is added.
    ``keys`` name columns of both input and result that a failing row keeps, so
    that it can be told which one failed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield work(pdf).assign(error=None)
                continue
            except Exception:  # find the rows to blame
                pass
            for i in range(len(pdf)):
                try:
                    yield work(pdf.iloc[[i]]).assign(error=None)
                except Exception as problem:
                    failed = {k: [pdf.iloc[i][k]] for k in keys} | {"error": [f"{type(problem).__name__}: {problem}"]}
                    yield pd.DataFrame(failed).reindex(columns=[*[c.split()[0] for c in schema.split(",")], "error"])

    return df.mapInPandas(run, f"{schema}, error string")
