"""BPE encoding by a compiled tokenization automaton.

The automaton reads tokens. It accepts a sequence exactly when the merge rules, applied in order,
give that sequence, so every string has one accepted path. It starts as one state with a loop per
base symbol; each rule (u, v -> w) is worked in by a gadget: the state p behind u is copied without
its arc v, all arcs u lead to the copy, and every state with an arc u gets an arc w to where v led.

Behind a token there is always one state, so the token names it. It is the last of a chain of copies:
those that gadgets made behind the token itself, before them those behind its right part up to its
own rule, and so on down to the start. The compiled table holds what each gadget cut, (u, v) -> rule
number, and a token's parts and rule. A transition walks back through the rules: the arc asked for
falls back to its left part where its own rule brought it, the state to the right part of its token,
and the arc is missing if the gadget that cut it is met on the way. That takes a few look-ups, where
a table of states times tokens would have two thousand million cells.

A word is encoded from left to right over its symbols: for each end place, the one token whose start
place has a state with an arc for it. Words are encoded once and kept while the table is small.
Decoding emits the labels of the arcs.

Null texts are empty and have no tokens. Repeated rows are encoded each. Other columns are not read.
An empty table gives an empty result.
"""
from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saddle.llm.rows import key_columns
from saddle.llm.textbytes import slices

END = "</w>"
#: Words kept per task, and code points of a text worked on at once.
KEPT_WORDS = 400_000
PIECE = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Automaton:
    """The compiled merge rules; tokens are numbers, and a state is named by the token before it (-1: the start)."""

    def __init__(self, tokens: int, merges: Iterable[tuple[int, int, int]]):
        rules = list(merges)
        self.size = tokens
        self.left, self.right = [-1] * tokens, [-1] * tokens
        self.rule = [-1] * tokens  # -1: base symbol
        self.cuts: dict[int, int] = {}
        made = {w for _, _, w in rules}
        self.live = [t not in made for t in range(tokens)]
        for number, (u, v, w) in enumerate(rules):
            # where the two never stand side by side the rule never applies
            if self.live[u] and self.live[v] and self.allows(u, v):
                self.cuts[u * tokens + v] = number
                self.left[w], self.right[w], self.rule[w], self.live[w] = u, v, number, True

    def allows(self, state: int, token: int) -> bool:
        """Whether the state behind ``state`` has an arc ``token``."""
        if state < 0:
            return True
        left, right, rule, cuts, size = self.left, self.right, self.rule, self.cuts, self.size
        before = upto = len(rule)  # rules that made the state's copies, and rules under which the arc is this one
        while True:
            number = cuts.get(state * size + token)
            if number is not None and number < before and number <= upto:
                return False
            if rule[token] >= rule[state]:
                if rule[token] < 0:
                    return True
                upto, token = rule[token], left[token]
            else:
                before, state = rule[state], right[state]


class Tokenizer:
    """A word-level BPE vocabulary file: normalisation, word pattern, merges and special strings."""

    def __init__(self, config: str):
        spec = json.loads(config)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None:
            raise ValueError("needs a BPE model with word ends and no decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, number in [*self.vocab.items(), *self.special.items()]:
            self.labels[number] = text
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        numbers = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(len(self.labels), numbers)
        self.longest = max(map(len, self.vocab))
        self.symbols = byte_symbols()
        splitter = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(splitter["pattern"]["Regex"])
        self.breaks = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.arcs: dict[int, bool] = {}

    def word(self, text: str) -> list[int]:
        """Tokens of one word, by transitions of the automaton."""
        s = "".join([self.symbols[b] for b in text.encode()])
        n, vocab, arcs = len(s), self.vocab, self.arcs
        automaton = self.automaton
        live, allows, size = automaton.live, automaton.allows, automaton.size
        state, came = [-1] + [None] * n, [None] * (n + 1)
        for end in range(1, n + 1):
            tail = END if end == n else ""
            for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                here = state[start]
                if here is None:
                    continue
                token = vocab.get(s[start:end] + tail)
                if token is None or not live[token]:
                    continue
                arc = here * size + token
                ok = arcs.get(arc)
                if ok is None:
                    ok = arcs[arc] = allows(here, token)
                if ok:
                    state[end], came[end] = token, (start, token)
                    break
        out, at = [], n
        while at:
            at, token = came[at]
            out.append(token)
        return out[::-1]

    def _plain(self, text: str) -> Iterator[bytes]:
        # a capital sigma has one lower case here, wherever it stands
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words, known = self.words.findall(text), self.known
        try:
            yield b"".join([known[w] for w in words])
            return
        except KeyError:
            pass
        if len(known) > KEPT_WORDS:
            known.clear()
            self.arcs.clear()
        for w in words:
            if w not in known:
                known[w] = np.array(self.word(w), dtype="<u4").tobytes()
        yield b"".join([known[w] for w in words])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special strings in it are their own tokens."""
        parts = []
        for piece in self.breaks.split(text) if self.breaks else [text]:
            if piece in self.special:
                parts.append(np.array([self.special[piece]], dtype="<u4").tobytes())
                continue
            at = 0
            while at < len(piece):
                cut = piece.find(" ", at + PIECE)  # no word and no combination goes over a blank
                cut = len(piece) if cut < 0 else cut
                parts.extend(self._plain(piece[at:cut]))
                at = cut
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The arc labels with blanks between, as a tokenizer without a decoder writes them."""
        return " ".join([self.labels[i] for i in ids])


def read_config(spark: SparkSession, path: str) -> str:
    """The vocabulary file's text; ``path`` may be local or any that Spark reads."""
    try:
        with open(path, encoding="utf-8") as file:
            return file.read()
    except OSError:
        return spark.read.text(path, wholetext=True).first()[0]


def encode(docs: DataFrame, config: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``key_1, key_2, doc_id, ids`` (an array of ints)."""
    rows = docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(config)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            for at, texts in slices(batch["text"]):
                ids = [tokenizer.encode(t or "") for t in texts.to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part["key_1"], part["key_2"], part["doc_id"], lists], ["key_1", "key_2", "doc_id", "ids"])

    return rows.mapInArrow(work, f"key_1 bigint, key_2 int, doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, config: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text beside it; a null array stays null."""
    shared = encoded.sparkSession.sparkContext.broadcast(config)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{name}` string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [None if x is None else tokenizer.decode(x) for x in (v.values.to_numpy() if v.is_valid else None for v in part[ids_col])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])

    return encoded.mapInArrow(work, schema)
