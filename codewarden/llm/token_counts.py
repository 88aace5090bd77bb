"""Token counts by byte-pair merging on a heap and a linked list.

The vocabulary file of the `tokenizers` library gives merges, normaliser and
pre-tokeniser; the count of a word is its initial symbols minus the merges that
apply.  Merges are found by popping the lowest-ranked adjacent pair from a heap;
neighbours are held in a doubly linked list, so a word of n bytes costs
O(n log n) also where it is very long.  No ids are produced.

White space is a token boundary in such vocabularies, so texts are cut at blanks
and counts of short pieces are remembered per worker.

* null text: empty, no tokens.
* bytes that are not UTF-8 count as U+FFFD.
* special tokens written inside a text count as one token each, the library's default.
* the vocabulary must drop white space in its pre-tokeniser (checked).
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import decoded, steps, texts

#: Pieces above this length are not remembered; a memory is emptied at KEEP entries.
SHORT, KEEP = 40, 800_000
# Latin text without white space: it is its own composed form, and lower case and
# classes are the same in every Unicode version, so it needs no library call.
_LATIN = regex.compile(r"[!-~\u00a1-\u024f]+")


def _byte_letters() -> dict[int, str]:
    """Printable letter of every byte in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes take the code points from 256 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class Counter(dict):
    """Number of tokens of a piece of text without blanks; fills itself."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE vocabularies with word ends are supported")
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.words: dict[str, int] = {}
        # The library's own steps for Latin text, if they are the usual ones.
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["invert"]
        self.latin = regex.compile(parts[0]["pattern"]["Regex"]) if plain else None
        if self.split.pre_tokenize_str(" a ")[0][0] != "a":
            raise ValueError("the vocabulary must drop white space")
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.suffix = model.get("end_of_word_suffix") or ""
        added = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only literal added tokens are supported")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= SHORT:
            if len(self) >= KEEP:
                self.clear()
            self[piece] = n
        return n

    def count(self, piece: str) -> int:
        if not piece:
            return 0
        if self.special and self.special.search(piece):
            parts = self.special.split(piece)
            return len(parts) // 2 + sum(self.plain(p) for p in parts[::2] if p)
        return self.plain(piece)

    def plain(self, piece: str) -> int:
        if self.latin and _LATIN.fullmatch(piece):
            return sum(map(self.word, self.latin.findall(piece.lower())))
        text = self.normal.normalize_str(piece) if self.normal else piece
        return sum(len(w) - self.merged(w) for w, _ in self.split.pre_tokenize_str(text))

    def word(self, word: str) -> int:
        """Tokens of one normalised word, not yet in the vocabulary's byte letters."""
        n = self.words.get(word)
        if n is None:
            letters = word.encode().decode("latin-1").translate(BYTE_LETTERS)
            n = len(letters) - self.merged(letters)
            if len(word) <= SHORT:
                if len(self.words) >= KEEP:
                    self.words.clear()
                self.words[word] = n
        return n

    def merged(self, word: str) -> int:
        """Number of merges that apply to the symbols of one word."""
        size, rank = len(word), self.rank
        symbol = list(word)
        symbol[-1] += self.suffix
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(size - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        n = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            # A stale entry: one side was merged meanwhile.
            if symbol[i] != a or j >= size or symbol[j] != b:
                continue
            n += 1
            symbol[i], symbol[j] = a + b, None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := rank.get((a + b, symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], a + b))
        return n

    def text(self, text: str) -> int:
        if "\n" in text:
            text = text.replace("\n", " ")
        return sum(map(self.__getitem__, text.split(" ")))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            n = [c.text(decoded(t)) for cols in steps([batch.select(["_cw_text"])]) for t in cols[0]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.octet_length(texts(text)).cast("long").alias("n_bytes"), texts(text).alias("_cw_text"))
    return (d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
