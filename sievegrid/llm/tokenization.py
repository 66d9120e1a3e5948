"""BPE encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton reads a word as a sequence of tokens. Before any merge it has one
state and an arc per symbol, so it accepts every way to write a word in symbols.
Each merge (u, v) -> w, in order, is one gadget: the state behind u's arcs is
copied without its arc v (so u is never followed by v again), u's arcs go to the
copy, and w's arcs are drawn from wherever u could start to where v led. What is
left accepts, for every word, exactly the one token sequence that the merges give.

All arcs of a token end in the same state, and a state differs from the one
it was copied from by one missing arc. An arc that is missing also keeps later
tokens that begin with it from being drawn. Tokens are numbered so that these are
an interval, hence a state is a short sorted list of disjoint intervals, and a
transition is a look into two tables: the token's end state and the state's gaps.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.packing import PLAIN_BYTES

START = 0
KEPT = 1 << 17
# White space of the splitter, and the controls that only Python takes for it.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROL = re.compile("[\x1c-\x1f]")
# Characters that normalizing leaves alone but for case (no control, no decomposed or odd letter).
PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u0233]+")
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SHOWN = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PLAIN_BYTES)))}
ROWS = 256


class Automaton:
    """Tables of the automaton: symbol trie, end state of each token, gaps of each state."""

    def __init__(self, merges: list[tuple[int, int, int]], symbols: list[tuple[int, str]]):
        """``merges`` as (u, v, w) in order, ``symbols`` as (token id, symbol)."""
        born = {w: k for k, (_, _, w) in enumerate(merges)}
        if len(born) != len(merges):
            raise ValueError("two merges make the same token")
        for k, (u, v, w) in enumerate(merges):
            if max(born.get(u, -1), born.get(v, -1)) >= k:
                raise ValueError("a merge comes before its parts")
        self._number(merges, symbols)
        self._build(merges, 1 + max([w for _, _, w in merges] + [s for s, _ in symbols], default=0))
        self._spell(merges, symbols)

    def _number(self, merges, symbols) -> None:
        """Preorder numbers in the forest "begins with", the youngest child first."""
        children: dict[int, list[int]] = {}
        times: dict[int, list[int]] = {}
        for k, (u, _, w) in enumerate(merges):
            children.setdefault(u, []).append(w)
            times.setdefault(u, []).append(k)
        place, last = {}, {}
        stack = [(s, False) for s, _ in reversed(symbols)]
        while stack:
            token, done = stack.pop()
            if done:
                last[token] = len(place) - 1
                continue
            place[token] = len(place)
            stack.append((token, True))
            stack += [(c, False) for c in children.get(token, [])]  # popped from the end: youngest first
        self.place, self._last, self._children, self._times = place, last, children, times

    def _gap(self, token: int, time: int) -> tuple[int, int]:
        """The token and all that begins with it by a merge at ``time`` (of the token with itself) or later."""
        older = bisect_left(self._times.get(token, []), time)
        younger = self._children.get(token, [])[older:]
        return self.place[token], self._last[younger[0]] if younger else self.place[token]

    def _build(self, merges, tokens: int) -> None:
        starts, stops = [[]], [[]]
        end = [START] * tokens
        made = {w for _, _, w in merges}
        reached = [t not in made for t in range(tokens)]
        for k, (u, v, w) in enumerate(merges):
            state = end[u]
            low, high = starts[state], stops[state]
            here = self.place[v]
            i = bisect_right(low, here)
            if not (reached[u] and reached[v]) or (i and here <= high[i - 1]):
                continue  # v never follows u any more, so w has no arcs
            first, past = self._gap(v, k)
            j = bisect_left(low, past + 1, i)  # gaps within the new one
            end[w], reached[w] = end[v], True
            starts.append(low[:i] + [first] + low[j:])
            stops.append(high[:i] + [past] + high[j:])
            end[u] = len(starts) - 1
        self.end, self.starts, self.stops, self.reached = end, starts, stops, reached

    def _spell(self, merges, symbols) -> None:
        """The trie of the tokens' symbols; a node is a pair of its arcs and its token, if any."""
        spelled = {s: (symbol,) for s, symbol in symbols}
        self.trie: list = [{}, None]
        for u, v, w in merges:
            spelled[w] = spelled[u] + spelled[v]
        for token, word in spelled.items():
            if not self.reached[token]:
                continue
            node = self.trie
            for symbol in word:
                node = node[0].setdefault(symbol, [{}, None])
            node[1] = token

    def follows(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token."""
        here = self.place[token]
        i = bisect_right(self.starts[state], here)
        return not i or here > self.stops[state][i - 1]

    def read(self, word: list[str]) -> list[int]:
        """The one accepted token sequence of a word of symbols.

        From each position the longest token comes first that the state has an
        arc for; a position from which no arc leads on is given up for the one before. No
        position is tried twice, since a beginning of the word has one accepted
        sequence, hence one state. Linear in the length, times the longest token's.
        """
        place, starts, stops, end, trie = self.place, self.starts, self.stops, self.end, self.trie
        n, at, state = len(word), 0, START
        tried, out, places, open_arcs = bytearray(n + 1), [], [], []
        while at < n:
            arcs, found = trie[0], []
            for to in range(at, n):
                node = arcs.get(word[to])
                if node is None:
                    break
                arcs, token = node
                if token is not None:
                    found.append((to + 1, token))
            places.append(at)
            open_arcs.append(found)
            while True:
                if found:
                    to, token = found.pop()
                    if not tried[to]:
                        here, low = place[token], starts[state]
                        i = bisect_right(low, here)
                        if not i or here > stops[state][i - 1]:
                            break
                else:
                    open_arcs.pop()
                    tried[places.pop()] = 1
                    if not out:
                        raise ValueError(f"no tokens for {''.join(word)!r}")
                    out.pop()
                    state, found = end[out[-1]] if out else START, open_arcs[-1]
            out.append(token)
            at, state = to, end[token]
        return out


class Tokenizer:
    """A tokenizer file with word ends: its automaton, its splitting, its special tokens.

    Splitting a text into words is the file's own normalizer and splitter, run
    by the library they are written for; merging is the automaton's. White space
    ends words and is dropped, so a text is read run by run between it, and
    runs that come again are looked up.
    """

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        pieces = stored["pre_tokenizer"]["pretokenizers"]
        drops_space = pieces[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]" in pieces[0]["pattern"]["Regex"]
        if model["type"] != "BPE" or odd or not drops_space or stored["decoder"] is not None:
            raise ValueError(f"not a plain BPE file with words and without a decoder: {path} {odd}")
        library = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.word_end = model["end_of_word_suffix"] or ""
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in stored["added_tokens"]):
            raise ValueError(f"special tokens that depend on their neighbours: {path}")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in pairs]
        made = {w for _, _, w in merges}
        symbols = [(i, s) for s, i in vocabulary.items() if i not in made]
        self.automaton = Automaton(merges, symbols)
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._special = re.compile(f"({'|'.join(longest_first)})") if self.special else None
        # The library's splitting is exact for any text; plain letters take the file's own pattern instead.
        known = stored["normalizer"] == NORMALIZER and [p["type"] for p in pieces] == ["Split", "ByteLevel"]
        self._split = regex.compile(pieces[0]["pattern"]["Regex"]).findall if known else None
        self._known: dict[str, bytes] = {}
        self._known_words: dict[str, bytes] = {}

    def _words(self, run: str) -> list[str]:
        """The words of characters without white space, each a string of symbols without the word end."""
        if self._split and PLAIN.fullmatch(run):
            return [w if w.isascii() else w.encode().decode("latin-1").translate(SHOWN) for w in self._split(run.lower())]
        plain = self.normalizer.normalize_str(run) if self.normalizer else run
        return [word for word, _ in self.splitter.pre_tokenize_str(plain)]

    def _run(self, run: str) -> bytes:
        """The ids of characters without white space."""
        if self._split and run.isascii() and run.isalpha():
            word = run.lower()
            coded = self._known_words.get(word) or self._word(word)
        else:
            coded = b"".join([self._known_words.get(w) or self._word(w) for w in self._words(run)])
        if len(run) <= 64:
            if len(self._known) >= KEPT:  # a memory of runs, not of all runs
                self._known.clear()
            self._known[run] = coded
        return coded

    def _word(self, word: str) -> bytes:
        symbols = list(word)
        symbols[-1] += self.word_end
        ids = self.automaton.read(symbols)
        coded = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self._known_words) >= KEPT:
                self._known_words.clear()
            self._known_words[word] = coded
        return coded

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, special tokens in it included."""
        known, run, out = self._known.get, self._run, []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                runs = SPACE.split(part) if CONTROL.search(part) else part.split()
                out += [known(r) or run(r) for r in runs if r]
        return np.frombuffer(b"".join(out), "<u4")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, compiled once per Python worker."""
    return Tokenizer(path)


@functools.lru_cache(maxsize=2)
def arc_labels(path: str) -> list[str]:
    """The label of every token of a file by its id, special tokens included."""
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    label_of = {i: label for label, i in stored["model"]["vocab"].items()}
    label_of |= {t["id"]: t["content"] for t in stored["added_tokens"]}
    return [label_of.get(i, "") for i in range(max(label_of) + 1)]


def spell(labels: list[str], ids: np.ndarray) -> str:
    """The labels of the arcs with a space between them."""
    return " ".join(map(labels.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text as unsigned little-endian 32-bit integers.

    Null counts as empty and gives no ids. Rows stay as they are, repeated ones
    too; a column that is called like ``ids`` is replaced.
    ``path`` must exist on every machine (a tokenizer file of an installed
    package); each Python worker compiles it once, in about a second, and
    keeps tables of a size that depends on the file only, and a bounded memory of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in _small(batches):
            found = [coder.encode(t or "").tobytes() for t in batch.column(text).to_pylist()]
            yield _with(batch, ids, pa.array(found, pa.binary()))

    rest = [c for c in docs.columns if c != ids]
    kept = docs.select(*rest)
    return kept.mapInArrow(run, f"{_schema(kept)}, `{ids}` binary")


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids; null counts as no ids. Columns called like ``text`` are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(path)
        for batch in _small(batches):
            found = [spell(labels, np.frombuffer(i or b"", "<u4")) for i in batch.column(ids).to_pylist()]
            yield _with(batch, text, pa.array(found, pa.string()))

    kept = docs.select(*[c for c in docs.columns if c != text])
    return kept.mapInArrow(run, f"{_schema(kept)}, `{text}` string")


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that ids and labels of few texts are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def digest(coded: DataFrame, key: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Counts and hashes of ids and decoded texts."""
    return coded.select(
        F.col(key).alias("doc_id"),
        F.floor(F.octet_length(ids) / F.lit(4)).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(text).cast("binary"), 256).alias("decoded_sha256"),
    )
