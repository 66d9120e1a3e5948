"""Parsing and checking of submissions, payloads and product names as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievegrid.functions.sequences import bind

# Largest payload in characters, token of an empty side.
MAX_PAYLOAD = 20480
NONE_TOKEN = "~"


def hash_matches_path(content: Column, path: Column) -> Column:
    """The file stem is the first 20 hex digits of the content hash."""
    stem = F.concat(F.lit("/"), F.substring(F.sha2(content, 256), 1, 20), F.lit(".txt"))
    return (content != "") & path.endswith(stem)


def payload_literal(content: Column) -> Column:
    """The integer of a ``(int, b'...')`` literal, null for anything else or too long text.

    Escapes are removed first, so that the pattern has no repeated group, whose
    depth would grow with the text.
    """
    plain = F.regexp_replace(content, r"(?s)\\.", "")
    literal = (
        r"""^\s*\(\s*([+-]?\d+)\s*,\s*[bB](?:'[^'\\\n]*+'|"[^"\\\n]*+")\s*,?\s*\)\s*\z"""
    )
    found = F.regexp_extract(plain, literal, 1)
    return F.when(F.length(content) <= MAX_PAYLOAD, F.nullif(found, F.lit("")).try_cast("bigint"))


def strip_uid_prefix(text: Column, uid: Column) -> Column:
    """Text after ``<uid>:``, null without that prefix."""
    prefix = F.concat(uid.cast("string"), F.lit(":"))
    return F.when(text.startswith(prefix), F.substring(text, F.length(prefix) + 1, F.length(text)))


def _side(part: Column) -> Column:
    listed = F.filter(F.split(part, ","), lambda x: x != "")
    return F.when(part == NONE_TOKEN, F.array().cast("array<string>")).otherwise(listed)


def parse_submission(text: Column) -> Column:
    """``mol,...|seq,...`` to a struct of two lists; null when malformed.

    Whitespace inside, non-ASCII characters, a wrong number of ``|`` and an
    empty side are all malformed.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+\z", "")
    sides = F.split(trimmed, r"\|")
    fine = (
        ~trimmed.rlike(r"\s")
        & ~trimmed.rlike(r"[^\x00-\x7F]")
        & (F.size(sides) == 2)
        & (F.get(sides, F.lit(0)) != "")
        & (F.get(sides, F.lit(1)) != "")
    )
    parsed = F.struct(
        _side(F.get(sides, F.lit(0))).alias("molecules"),
        _side(F.get(sides, F.lit(1))).alias("sequences"),
    )
    return F.when(fine, parsed)


def path_parts(path: Column) -> Column:
    """Owner, repository, branch and file of a path with at least four parts."""
    parts = F.split(path, "/")
    named = F.struct(
        F.get(parts, F.lit(0)).alias("owner"),
        F.get(parts, F.lit(1)).alias("repo"),
        F.get(parts, F.lit(2)).alias("branch"),
        F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "/").alias("file"),
    )
    return F.when(F.size(parts) >= 4, named)


def reaction_allowed(name: Column, allowed: str | None) -> Column:
    """Integer-normalised ``rxn:<n>`` equality; without a filter everything is allowed."""
    if allowed is None:
        return F.lit(True)
    number = F.trim(F.get(F.split(name, ":"), F.lit(1))).try_cast("int")
    match = F.concat(F.lit("rxn:"), number.cast("string")) == allowed
    return F.when(name.startswith("rxn:"), F.coalesce(match, F.lit(False))).otherwise(False)


def reaction_in(name: Column, allowed: Sequence[str]) -> Column:
    out = F.lit(False)
    for reaction in allowed:
        out = out | reaction_allowed(name, reaction)
    return out


def strip_quotes(name: Column) -> Column:
    return F.translate(name, "'\"", "")


def parse_product(name: Column) -> Column:
    """``rxn:<rxn>:<m1>:<m2>[:<m3>]`` to a struct, null for any other shape."""

    def build(parts):
        number = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
        three = F.size(parts) == 5
        fine = (
            (F.get(parts, F.lit(0)) == "rxn")
            & F.size(parts).isin(4, 5)
            & number(1).isNotNull()
            & number(2).isNotNull()
            & number(3).isNotNull()
            & (~three | number(4).isNotNull())
        )
        product = F.struct(
            number(1).cast("int").alias("rxn"),
            number(2).alias("m1"),
            number(3).alias("m2"),
            F.when(three, number(4)).alias("m3"),
        )
        return F.when(fine, product)

    return bind(F.split(strip_quotes(name), ":"), build)


_ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]"


def smiles_atoms(smiles: Column) -> Column:
    """Element symbols of the heavy atoms: organic subset and bracket atoms, hydrogen left out."""
    tokens = F.regexp_extract_all(smiles, F.lit(f"({_ATOM})"), F.lit(1))
    symbol = lambda t: F.when(
        t.startswith("["), F.regexp_extract(t, r"^\[\d*([A-Z][a-z]?|[a-z]{1,2})", 1)
    ).otherwise(t)
    return F.filter(
        F.transform(tokens, lambda t: F.initcap(symbol(t))), lambda s: ~s.isin("H", "")
    )


def heavy_atoms(smiles: Column) -> Column:
    return F.size(smiles_atoms(smiles))


def contains_element(smiles: Column, banned: Sequence[str]) -> Column:
    return F.arrays_overlap(smiles_atoms(smiles), F.array(*[F.lit(b) for b in banned]))
