"""Byte-pair encoding and decoding by batched numpy merge rounds.

The vocabulary is a ``tokenizers`` JSON file of the word-end kind (lower case, white space dropped).
Each distinct run of non-space characters of a batch is encoded once: its words lie in one flat
symbol array, every round finds all pairs' ranks by binary search over the sorted pair keys, takes
each word's lowest rank and merges its occurrences from left to right, until no pair has a rank.

Defined results: a null text is an empty text and has no tokens; texts are taken whole at any
length; equal texts get equal ids; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from cdrspark.llm.common import from_texts, remembered

#: Code points with the White_Space property, which the vocabulary's patterns call \s (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Those that str.split() takes for spaces and the vocabulary does not.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
CHUNKS = regex.compile(f"[^{SPACE}]+")
#: The longest run of characters that is remembered, and how many runs are (about 400 bytes each, in every Python worker).
REMEMBERED_CHARS, REMEMBERED = 64, 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class WordEndBpe:
    """Encoder and decoder of one vocabulary file, given as text."""

    def __init__(self, text: str, remembered: int | None = None):
        self.most = REMEMBERED if remembered is None else remembered
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.id_text = {i: str(i) for i in [*vocab.values(), *self.special.values()]}
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE))
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.last_id = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        # Within a merge the left part never ends a word, so the merged token is the two texts joined.
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], order.astype(np.int64), joined
        self.none = len(keys)
        self.ids_of: dict[str, str] = {}
        self.tokens_of: dict[str, str] = {}

    # -- merging --------------------------------------------------------------------------

    def _ranks_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each of these places, `none` where there is none."""
        ranks = np.full(len(at), self.none, np.int64)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        key = symbols[at[inner]] << 32 | symbols[at[inner] + 1]
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        found = self.keys[place] == key
        ranks[inner[found]] = self.ranks[place[found]]
        return ranks

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (non-empty bytes), by merge rounds over all of them at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        if not words:
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), size)
        symbols = self.byte_id[flat]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last_id[flat[ends]]
        ranks = self._ranks_at(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(ranks, start)
            length = np.diff(np.r_[start, len(word)])
            done = lowest == self.none
            if done.any():
                for s, n in zip(start[done].tolist(), length[done].tolist(), strict=True):
                    out[word[s]] = symbols[s : s + n]
                keep = np.repeat(~done, length)
                symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
                lowest, length = lowest[~done], length[~done]
            low = np.repeat(lowest, length)
            # Of a run of overlapping occurrences (as in "aaaa") every second one merges, from its left end.
            at = np.flatnonzero(ranks == low)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1][: len(at)])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[nth % 2 == 0]
            symbols[at] = self.joined[low[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            # Only pairs that start at a merged symbol or just before one have changed.
            changed = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            ranks[changed] = self._ranks_at(symbols, word, changed)
        return out

    # -- texts ----------------------------------------------------------------------------

    def _words(self, chunk: str) -> list[int | str]:
        """Special ids and words of a run of non-space characters."""
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in ".,":
                return [low[:-1], low[-1]]
        parts: list[int | str] = []
        for piece in self.split_special.split(chunk) if self.split_special and "<|" in chunk else [chunk]:
            if piece in self.special:
                parts.append(self.special[piece])
            elif piece:
                piece = unicodedata.normalize("NFC", piece)
                piece = "".join(c.lower() for c in piece) if "Σ" in piece else piece.lower()
                parts += self.pattern.findall(piece)
        return parts

    def _learn(self, chunks: set[str]) -> None:
        """Remember these runs' ids and tokens, both as text with single spaces between."""
        parts = {c: self._words(c) for c in chunks}
        every = {w for p in parts.values() for w in p if isinstance(w, str)}
        # A word in lower case that was met as a run by itself has the same ids.
        met = every & self.ids_of.keys()
        met = {w for w in met if w.isascii() and w.isalpha() and w == w.lower()}
        as_text = {i: str(i) for i in self.special.values()} | {w: self.ids_of[w] for w in met}
        as_tokens = {i: t for t, i in self.special.items()} | {w: self.tokens_of[w] for w in met}
        words = list(every - met)
        for w, x in zip(words, self.merge([w.encode("utf-8") for w in words]), strict=True):
            own = x.tolist()
            as_text[w] = self.id_text[own[0]] if len(own) == 1 else " ".join([self.id_text[i] for i in own])
            as_tokens[w] = self.token_of[own[0]] if len(own) == 1 else " ".join([self.token_of[i] for i in own])
        for c, p in parts.items():
            if len(p) == 1:
                self.ids_of[c], self.tokens_of[c] = as_text[p[0]], as_tokens[p[0]]
            else:
                self.ids_of[c] = " ".join([as_text[w] for w in p])
                self.tokens_of[c] = " ".join([as_tokens[w] for w in p])

    def decode(self, ids) -> str:
        """The tokens of the ids, special ones included, with single spaces between; unknown ids are left out."""
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)

    def chunks(self, text: str) -> list[str]:
        return CHUNKS.findall(text) if NOT_SPACE.search(text) else text.split()

    def encoded(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text its ids and their tokens (the decoded text), both with single spaces between."""
        runs = [self.chunks(t) if t else [] for t in texts]
        every = set().union(*runs)
        if new := every - self.ids_of.keys():
            if len(self.ids_of) + len(new) > self.most:  # keep what these texts use
                old = every - new
                self.ids_of = {c: self.ids_of[c] for c in old}
                self.tokens_of = {c: self.tokens_of[c] for c in old}
            self._learn(new)
        ids, tokens = self.ids_of.__getitem__, self.tokens_of.__getitem__
        out = [(" ".join(map(ids, r)), " ".join(map(tokens, r))) for r in runs]
        for c in every:
            if len(c) > REMEMBERED_CHARS:
                del self.ids_of[c], self.tokens_of[c]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encoded([text])[0][0].split()]


def encode_table(docs: DataFrame, vocabulary: str, with_ids: bool = False, with_decoded: bool = False, remembered_runs: int = REMEMBERED) -> DataFrame:
    """docs' columns but text, plus n_tokens, ids_sha256, decoded_sha256 (and ids and decoded if wanted).

    Columns of docs with the same names as these are replaced. The vocabulary file is read on the
    driver and sent to the executors (its size is fixed).
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    memory = f"bpe {remembered_runs} {vocabulary}"
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "string"} if with_decoded else {})

    def start():
        # Later tasks of a worker know what earlier ones met.
        bpe = remembered(memory, lambda: WordEndBpe(sent.value, remembered_runs))

        def encode(texts: list[str | None]) -> dict[str, list]:
            rows = bpe.encoded(texts)
            out = {
                "n_tokens": [ids.count(" ") + 1 if ids else 0 for ids, _ in rows],
                "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in rows],
                "decoded_sha256": [hashlib.sha256(decoded.encode("utf-8")).hexdigest() for _, decoded in rows],
            }
            if with_ids:
                out["ids"] = [np.array(ids.split(), np.int32) for ids, _ in rows]
            if with_decoded:
                out["decoded"] = [decoded for _, decoded in rows]
            return out

        return encode

    return from_texts(docs, made, start, slice_bytes=2_000_000, memory=memory)


def op9_bpe_numpy_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_table(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
