"""Token counts by byte-pair merging over a linked list, with a heap of adjacent pairs."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Generations, kept, slices, without_cycles


WIDE = 1 << 20
# The vocabulary file's splitting pattern as it reads on lower-case ASCII.
PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
PRINTED = re.compile("[!-~]+")
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def merges_made(sym: list[int], ranks: dict[int, int], joined: list[int]) -> int:
    """How many merges byte-pair encoding makes in the symbols ``sym``, which it overwrites.

    ranks: of the pair a, b under a * WIDE + b; joined: by rank, the symbol that the pair becomes. The heap holds rank and
    place, so the lowest rank comes first, then the leftmost place; an entry whose pair has changed since is skipped.
    """
    n, get, push, pop = len(sym), ranks.get, heapq.heappush, heapq.heappop
    left, right, bits, made = list(range(-1, n - 1)), list(range(1, n + 1)), n.bit_length(), 0
    now = [get(a * WIDE + b) for a, b in zip(sym, sym[1:])]  # rank of the pair at a place, None if it is never merged
    now.append(None)
    heap = [r << bits | i for i, r in enumerate(now) if r is not None]
    heapq.heapify(heap)
    low = (1 << bits) - 1
    while heap:
        best = pop(heap)
        i = best & low
        if now[i] != best >> bits:
            continue
        sym[i] = s = joined[best >> bits]
        j = right[i]
        now[j] = now[i] = None
        k = right[i] = right[j]
        made += 1
        if k < n:
            left[k] = i
            now[i] = r = get(s * WIDE + sym[k])
            if r is not None:
                push(heap, r << bits | i)
        if (h := left[i]) >= 0:
            now[h] = r = get(sym[h] * WIDE + s)
            if r is not None:
                push(heap, r << bits | h)
    return made


class TokenCounter:
    """Counts tokens as the tokenizers library does with a BPE file whose pretokenizer never crosses ASCII white space.

    The library's own normalizer and pretokenizer cut a chunk into words; the merges are made here and no identifiers
    are formed. Counts of chunks and words are kept in two generations of ``cache`` entries at most.
    """

    def __init__(self, path: str, cache: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        t = Tokenizer.from_file(path)
        self.normalize, self.split = t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": SPLIT}:
            raise ValueError("the short cut for ASCII words does not hold for this splitting pattern")
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        number = {s: i for i, s in enumerate(model["vocab"])}
        self.number = number
        self.ranks = {number[a] * WIDE + number[b]: i for i, (a, b) in enumerate(merges)}
        self.joined = [number[a + b] for a, b in merges]
        added = [a["content"] for a in spec["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.chunks, self.known = Generations(cache), Generations(cache)

    def words(self, chunk: str) -> tuple[list[str], int]:
        """The words of a chunk and how many added tokens stand in it."""
        if PRINTED.fullmatch(chunk) and "<|" not in chunk:
            # Of printed ASCII the library's normal form is its lower case, and byte-level spelling leaves it as it is.
            return PLAIN.findall(chunk.lower()), 0
        parts = self.added.split(chunk) if self.added else [chunk]
        return [w for p in parts[::2] if p for w, _ in self.split(self.normalize(p)) if w], len(parts) // 2

    def learn(self, word: str) -> int:
        """Tokens of a word: initial symbols minus merges."""
        number = self.number
        symbols = [number[c] for c in word[:-1]] + [number[word[-1] + self.suffix]]
        return len(word) - merges_made(symbols, self.ranks, self.joined)

    def count(self, chunk: str) -> int:
        words, n = self.words(chunk)
        known = self.known
        for w in words:
            got = known.young.get(w)
            if got is None and (got := known.get(w)) is None:
                got = known.put(w, self.learn(w))
            n += got
        return n

    def many(self, texts: list[str | None]) -> list[int]:
        """Counts for a run of texts."""
        held, chunks, now = [SPACES.split(t or "") for t in texts], self.chunks, {"": 0}
        for c in set().union(*held) - {""}:
            got = chunks.young.get(c)
            if got is None and (got := chunks.get(c)) is None:
                got = chunks.put(c, self.count(c))
            now[c] = got
        return [sum([now[c] for c in h]) for h in held]


def loaded(path: str) -> TokenCounter:
    """One counter for each worker process: what it has learned serves the tasks that follow."""
    return kept(("tokens", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_tokens, over_limit)``. Null text counts as empty; each row counts by itself, so ties and repeats need nothing."""

    @pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = loaded(path)
        for s in batches:
            with without_cycles():
                counts = [n for run in slices(s) for n in count.many(run)]
            yield pd.Series(counts, dtype="int64")

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
