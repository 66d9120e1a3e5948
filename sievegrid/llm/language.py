"""Language of a document: text, declared language, address suffix and host, fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.toxicity import _with
from sievegrid.session import durable

BINS = 1 << 15
PIECE = 1 << 21
UNKNOWN = "und"
REST = "mis"
BROADCAST, HOT = 1 << 24, 1000


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWERED = _lowered()


def trigrams(batch_column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner row, bin) of every byte trigram of a string column, in pieces of bounded size.

    ASCII letters are lower-cased, digits and other ASCII signs are one sign, so
    bins stand for letters and word borders. Nulls have no trigrams.
    """
    column = batch_column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    plain = LOWERED.copy()
    for b in range(128):
        if not chr(b).isalpha():
            plain[b] = 32
    for begin in range(int(offsets[0]), int(offsets[-1]), PIECE):
        end = min(begin + PIECE, int(offsets[-1]))
        x = plain[data[begin : min(end + 2, int(offsets[-1]))]].astype(np.uint32)
        if len(x) < 3:
            continue
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        at = np.arange(begin, begin + len(code))
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[owner + 1]
        blank = code == 0x202020
        keep = inside & ~blank
        yield owner[keep], ((code[keep] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def declared_language(column: Column) -> Column:
    """Primary subtag in lower case; null for none."""
    tag = F.lower(F.regexp_extract(F.trim(column), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    """Host of an address in lower case; a value without a scheme counts as a host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1))


class Model:
    """Trigrams by language, declared by language, and counts by host level.

    ``levels[0]`` has the counts of all documents. ``names`` is a DataFrame
    (level, name, facts) with the counts by language of every suffix (1), domain
    (2) and host (3); it stays on the driver's side.
    """

    def __init__(self, languages: list[str], text: np.ndarray):
        self.languages, self.text = languages, text
        self.declared = np.zeros((len(languages) + 2, len(languages)))
        self.levels: list[np.ndarray] = []
        self.names: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"names": None}

    def text_scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (rows x languages) and numbers of trigrams."""
        n = len(column)
        scores, counts = np.zeros((n, len(self.languages))), np.zeros(n)
        for owner, bins in trigrams(column):
            counts += np.bincount(owner, minlength=n)
            for k in range(len(self.languages)):
                scores[:, k] += np.bincount(owner, self.text[k][bins], n)
        return scores, counts

    def prior(self, levels: np.ndarray, strength: float) -> np.ndarray:
        """Log prior (rows x languages): each level's counts, smoothed towards the level above."""
        return self.smoothed([table[at] for table, at in zip(self.levels[1:], levels.T)], len(levels), strength)

    def smoothed(self, counts: list[np.ndarray], n: int, strength: float) -> np.ndarray:
        """``prior`` of ``n`` rows with the given counts (rows x languages) of every level below the first."""
        total = self.levels[0][0]
        share = np.broadcast_to((total + 1) / (total.sum() + len(total)), (n, len(total)))
        for found in counts:
            share = (found + strength * share) / (found.sum(1, keepdims=True) + strength)
        return np.log(share)


def _evidence(docs: DataFrame, declared: str | None, host: str | None) -> DataFrame:
    """``docs`` with _declared and _host."""
    return docs.withColumns(
        {
            "_declared": declared_language(F.col(declared)) if declared else F.lit(None).cast("string"),
            "_host": host_of(F.col(host)) if host else F.lit(""),
        }
    )


def names_of(address: Column) -> list[Column]:
    """Suffix, domain and host of a host's name."""
    labels = F.split(address, r"\.")
    n = F.size(labels)
    suffix = F.when(n > 1, F.element_at(labels, -1)).otherwise("")
    domain = F.when(n > 1, F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)))).otherwise(address)
    return [suffix, domain, address]


def _with_prior(rows: DataFrame, model: Model, strength: float) -> DataFrame:
    """``rows`` with _prior: the log prior of their _host, an array of doubles as bytes.

    Priors are made once per host, from counts joined by name. They are broadcast
    where they fit in ``BROADCAST`` bytes; else only those of hosts with more than
    one of ``HOT`` rows are, and the others are joined by name.
    """
    size = len(model.languages)
    placed = durable(rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_rows")))
    all_hosts, all_rows = placed.agg(F.count("_host"), F.sum("_rows")).first()
    for level, name in enumerate(names_of(F.col("_host")), 1):
        known = model.names.filter(F.col("level") == level).select(F.col("name").alias("_name"), F.col("facts").alias(f"_{level}"))
        placed = placed.withColumn("_name", name).join(known, "_name", "left").drop("_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                tables = []
                for level in (1, 2, 3):
                    table = np.zeros((batch.num_rows, size))
                    for i, facts in enumerate(batch.column(f"_{level}").to_pylist()):
                        for fact in facts or ():
                            table[i, fact["k"]] = fact["n"]
                    tables.append(table)
                prior = pa.array([x.tobytes() for x in model.smoothed(tables, batch.num_rows, strength)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_host"), batch.column("_rows"), prior], names=["_host", "_rows", "_prior"])

    priors = durable(placed.mapInArrow(run, "_host string, _rows long, _prior binary"))
    if all_hosts * (8 * size + 64) <= BROADCAST:
        return rows.join(F.broadcast(priors.drop("_rows")), "_host")
    is_hot = F.col("_rows") > all_rows / HOT
    hot = priors.filter(is_hot).select("_host", F.col("_prior").alias("_hot"))
    cold = priors.filter(~is_hot).select(F.concat(F.lit("="), "_host").alias("_key"), "_prior")
    salt = F.concat(F.lit("#"), F.xxhash64(*rows.columns).cast("string"))
    spread = rows.join(F.broadcast(hot), "_host", "left")
    spread = spread.withColumn("_key", F.when(F.col("_hot").isNull(), F.concat(F.lit("="), "_host")).otherwise(salt))
    return spread.join(cold, "_key", "left").withColumn("_prior", F.coalesce("_hot", "_prior")).drop("_key", "_hot")


def fit(
    docs: DataFrame,
    text: str = "text",
    declared: str = "lang",
    host: str | None = "source",
    least: int = 100,
    part: float = 1e-6,
) -> Model:
    """Language models and evidence tables from all of ``docs``.

    The languages are all declared ones with ``least`` bytes of text and ``part``
    of all declared bytes; the others together are one class, ``mis``, so that
    their documents don't take a wrong language. Aggregations over all rows, each
    summed up inside the tasks first: bytes, then trigram counts, by declared
    language; then, with the language that the text alone points to, counts by
    declared language and by host. Counts by suffix, domain and host stay a
    DataFrame by name, so no two hosts share counts.
    """
    rows = _evidence(docs.select(F.col(text).alias("text"), *[c for c in {declared, host} if c]), declared, host)
    rows = rows.select("text", "_declared", "_host")
    named = rows.filter("_declared IS NOT NULL").groupBy("_declared").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"))
    found = {r[0]: r[1] for r in named.collect()}
    enough = max(least, part * sum(found.values()))
    own = {x for x, n in found.items() if n >= enough and x != REST}
    languages = sorted(own | ({REST} if any(n for x, n in found.items() if x not in own) else set()))
    place = {x: i for i, x in enumerate(languages)}
    pooled = place.get(REST, -1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            tags = np.array([place.get(t, pooled) if t else -1 for t in batch.column("_declared").to_pylist()])
            for owner, bins in trigrams(batch.column("text")):
                tag = tags[owner]
                for k in np.unique(tag[tag >= 0]):
                    seen[k] = seen.get(k, 0) + np.bincount(bins[tag == k], minlength=BINS)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": np.full(len(at), k, np.int32), "bin": at.astype(np.int32), "n": n[at].astype(np.int64)})

    counts = np.zeros((len(languages), BINS))
    summed = rows.select("text", "_declared").mapInArrow(count, "k int, bin int, n long").groupBy("k", "bin").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    counts[found["k"], found["bin"]] = found["n"]
    text_table = np.log(counts + 0.5) - np.log((counts + 0.5).sum(1, keepdims=True)) if languages else counts
    model = Model(languages, text_table.astype(np.float32))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, n = model.text_scores(batch.column("text"))
            best = np.where(n > 0, scores.argmax(1), -1).astype(np.int32)
            tags = [place.get(t, len(languages)) if t else len(languages) + 1 for t in batch.column("_declared").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(best), pa.array(tags, pa.int32()), batch.column("_host")], names=["k", "d", "host"]
            )

    model.levels = [np.zeros((1, len(languages)))]
    if languages:
        votes = rows.mapInArrow(vote, "k int, d int, host string").filter("k >= 0")
        votes = durable(votes.groupBy("k", "d", "host").agg(F.count("k").alias("n")))
        for r in votes.groupBy("k", "d").agg(F.sum("n").alias("n")).collect():
            model.declared[r.d, r.k] = r.n
        model.levels[0][0] = model.declared.sum(0)
        names = F.array(*[F.struct(F.lit(i).alias("level"), c.alias("name")) for i, c in enumerate(names_of(F.col("host")), 1)])
        facts = votes.select("k", "n", F.explode(names).alias("f")).groupBy("f.level", "f.name", "k").agg(F.sum("n").alias("n"))
        model.names = durable(facts.groupBy("level", "name").agg(F.collect_list(F.struct("k", "n")).alias("facts")))
    return model


def identify(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    declared: str | None = "lang",
    host: str | None = "source",
    accepted: list[str] | None = None,
    least: float = 0.5,
    strength: float = 20.0,
    weight: float = 200.0,
) -> DataFrame:
    """``docs`` with language, posterior and kept; rows are shuffled only where hosts are too many to broadcast.

    The posterior joins the text's likelihood (n trigrams count as
    n / (1 + n / ``weight``), since neighbours depend on each other), the chance
    of the declared tag in each language, and the host's prior, smoothed by
    ``strength`` pseudo-documents of its domain, that of its suffix, and that of
    all. Texts without letters are ``und`` and rejected, null ones too; others
    are rejected below ``least`` or outside ``accepted``. Columns named like the
    three new ones are replaced.
    """
    plain = docs.drop("language", "posterior", "kept")
    rows = _evidence(plain, declared, host)
    place = {x: i for i, x in enumerate(model.languages)}
    size = len(model.languages)
    columns = plain.columns
    wanted = None if accepted is None else set(accepted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = np.log((model.declared + 0.5) / (model.declared + 0.5).sum(0, keepdims=True)) if size else None
        for batch in batches:
            names, posts = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if size and batch.num_rows:
                scores, n = model.text_scores(batch.column(text))
                total = scores / np.maximum(n, 1)[:, None] * (n / (1 + n / weight))[:, None]
                tags = [place.get(t, size) if t else size + 1 for t in batch.column("_declared").to_pylist()]
                total += rate[tags]
                total += np.frombuffer(b"".join(batch.column("_prior").to_pylist()), np.float64).reshape(-1, size)
                total -= total.max(1, keepdims=True)
                chance = np.exp(total)
                chance /= chance.sum(1, keepdims=True)
                best = chance.argmax(1)
                posts = np.where(n > 0, chance[np.arange(len(best)), best], 0.0)
                names = [model.languages[b] if m else UNKNOWN for b, m in zip(best, n > 0)]
            kept = [x != UNKNOWN and p >= least and (wanted is None or x in wanted) for x, p in zip(names, posts)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(names, pa.string()), pa.array(posts), pa.array(kept, pa.bool_())],
                names=[*columns, "language", "posterior", "kept"],
            )

    if size:
        rows = _with_prior(rows, model, strength)
    return rows.mapInArrow(run, _with(plain, "language string, posterior double, kept boolean"))
