"""Encoding by a vocabulary and merges, and back."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.batches import slices


class Encoder:
    """The rules for one token or piece. Results depend on nothing but the token."""

    def __init__(self, token_to_id: dict[str, int], merges=(), separator: str = "@@", core: str = "ఀ-౿", unk: int = 1):
        self.ids, self.sep, self.unk = token_to_id, separator, unk
        self.rank = {(m[0], m[1]): r for r, m in enumerate(merges)}
        self.core = re.compile(f"[{core}]")
        self.runs = re.compile(f"[{core}]+|[^{core}]+")

    def merged(self, word: str) -> list[str]:
        """The symbols that are left of a word: while a pair can be merged, all pairs of the lowest rank are, from left to right.

        Symbols are a doubly linked list, possible merges a priority queue of (rank, place); places that no longer hold their pair are skipped.
        """
        sym = list(word)
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, places = heap[0][0], []
            while heap and heap[0][0] == rank:
                places.append(heapq.heappop(heap)[1])
            changed = []
            for i in places:
                j = after[i]
                if sym[i] is None or j < 0 or self.rank.get((sym[i], sym[j])) != rank:
                    continue
                sym[i], sym[j] = sym[i] + sym[j], None
                after[i] = after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                changed.append(i)
            for i in changed:
                if sym[i] is None:
                    continue
                for a in (before[i], i):
                    if a >= 0 and after[a] >= 0 and (r := self.rank.get((sym[a], sym[after[a]]))) is not None:
                        heapq.heappush(heap, (r, a))
        return [s for s in sym if s is not None]

    def _letters(self, bare: str, continued: bool) -> list[int]:
        """A core token outside the vocabulary, letter by letter: marked letters but for the last of a word."""
        ids = [self.ids.get(c + self.sep, self.unk) for c in bare[:-1]]
        if bare:
            last = self.ids.get(bare[-1], self.unk)
            ids.append(self.ids.get(bare[-1] + self.sep, last) if continued else last)
        return ids

    def _others(self, bare: str) -> list[int]:
        """Another token without merges, character by character: marked, else bare, else unknown."""
        ids = [self.ids.get(c + self.sep, self.ids.get(c, self.unk)) for c in bare[:-1]]
        return ids + [self.ids.get(bare[-1], self.unk)] if bare else ids

    def _symbols(self, bare: str) -> list[int]:
        symbols, ids = self.merged(bare), []
        for k, s in enumerate(symbols):
            last = k == len(symbols) - 1
            if (i := self.ids.get(s if last else s + self.sep)) is not None:
                ids.append(i)
            else:
                ids += [self.ids.get(c + self.sep, self.unk) for c in (s[:-1] if last else s)]
                if last:
                    ids.append(self.ids.get(s[-1], self.unk))
        return ids

    def token(self, token: str) -> list[int]:
        """Ids of one token, which may end in the separator."""
        if (i := self.ids.get(token)) is not None:
            return [i]
        continued = token.endswith(self.sep)
        bare = token[: -len(self.sep)] if continued else token
        if self.core.search(bare):
            return self._letters(bare, continued)
        ids = self._symbols(bare) if self.rank else self._others(bare)
        if continued and ids:
            tail = (self.merged(bare) if self.rank else bare)[-1]
            for s in (tail, tail[-1:]):  # the last id becomes its marked form if there is one
                if ids[-1] == self.ids.get(s) and s + self.sep in self.ids:
                    ids[-1] = self.ids[s + self.sep]
                    break
        return ids

    def piece(self, piece: str) -> list[int]:
        """Ids of a whitespace-separated piece; one that mixes scripts is cut into runs with marks."""
        if (i := self.ids.get(piece)) is not None:
            return [i]
        if not self.core.search(piece):
            return self.token(piece)
        parts = self.runs.findall(piece)
        return [i for r in [*(r if r.endswith(self.sep) else r + self.sep for r in parts[:-1]), parts[-1]] for i in self.token(r)]


def _encode(batches: Iterator[pa.RecordBatch], e: Encoder, bos: int | None, eos: int | None, pieces: bool, most: int = 300_000) -> Iterator[pa.RecordBatch]:
    memory: dict[str, list[int]] = {}
    rule = e.piece if pieces else e.token
    for part in slices(batches):
        rows = []
        for text in part.column("text").to_pylist():
            ids: list[int] = []
            for w in text.split() if text else ():
                if (x := memory.get(w)) is None:
                    if len(memory) >= most:
                        memory.clear()
                    x = memory[w] = rule(w)
                ids += x
            rows.append([bos] * (bos is not None) + ids + [eos] * (eos is not None) if ids else ids)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])


def encoded(docs: DataFrame, encoder: Encoder, id: str = "doc_id", bos: int | None = None, eos: int | None = None, pieces: bool = False) -> DataFrame:
    """(id, ids): each document's tokens, looked up or taken apart; no shuffle. Null and blank texts give an empty array.

    bos and eos are put around a document that has ids. pieces: the text is raw, and pieces that mix scripts are cut into runs first. The vocabulary, whose
    size is checked, goes to the tasks once; each distinct token of a task is encoded once.
    """
    checked(len(encoder.ids))
    sent = docs.sparkSession.sparkContext.broadcast(encoder)
    return docs.select(F.col(id).alias("id"), "text").mapInArrow(lambda it: _encode(it, sent.value, bos, eos, pieces), "id bigint, ids array<int>").withColumnRenamed("id", id)


def checked(tokens: int) -> None:
    """Refuses to send a vocabulary of more than MOST_TOKENS tokens to all tasks."""
    if tokens > MOST_TOKENS:
        raise ValueError(f"{tokens} tokens; at most {MOST_TOKENS} are sent to all tasks")


def vocabulary(tokenizer: DataFrame) -> DataFrame:
    """(token, id) rows of a tokenizer's map."""
    return tokenizer.select(F.explode("token_to_id").alias("token", "id"))


def encoder_of(tokenizer: DataFrame, merges: bool = True, core: str = "ఀ-౿") -> Encoder:
    """The encoder of a tokenizer table's one row."""
    r = tokenizer.select("token_to_id", "bpe_merges", "separator", "special_tokens").first()
    return Encoder(dict(r["token_to_id"]), [(a, b) for a, b in r["bpe_merges"]] if merges else (), r["separator"], core, r["special_tokens"]["<unk>"])


def _words(batches: Iterator[pa.RecordBatch], ids: dict[str, int], unk: int, bos: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [[bos, *(ids.get(w, unk) for w in t.split())] if t and not t.isspace() else None for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])


def word_level(docs: DataFrame, vocab: DataFrame, unk: int = 1, bos: int = 2, id: str = "doc_id") -> DataFrame:
    """(id, ids): exact lookup of pieces within the row, unknown ones as unk, bos in front, no eos. Documents without text, or a blank one, have no row."""
    checked(vocab.count())
    sent = docs.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in vocab.select("token", "id").collect()})
    rows = docs.select(F.col(id).alias("id"), "text").mapInArrow(lambda it: _words(it, sent.value, unk, bos), "id bigint, ids array<int>")
    return rows.where("ids IS NOT NULL").withColumnRenamed("id", id)


def decoded(rows: DataFrame, vocab: DataFrame, id: str = "doc_id", skip=(0, 2, 3), strip_rest: bool = False) -> DataFrame:
    """(id, text): the tokens of the ids joined, marks glued; pad, bos and eos left out, an id without a token as <unk>. strip_rest also
    deletes marks that glue nothing.

    The vocabulary (token, id), whose size is checked, goes to the tasks as one array; rows aren't exploded or shuffled. A null array gives null.
    """
    size = vocab.agg(F.count("*"), F.max("id")).first()
    checked(max(size[0], size[1] or 0))
    by_id = ["<unk>"] * ((size[1] or 0) + 1)
    for r in vocab.select("id", "token").collect():
        by_id[r["id"]] = r["token"]
    array = rows.sparkSession.createDataFrame([(by_id,)], "_tokens array<string>")
    tokens = F.transform(F.filter("ids", lambda x: ~x.isin(*skip)), lambda x: F.coalesce(F.get(F.col("_tokens"), x), F.lit("<unk>")))
    return rows.select(id, "ids").crossJoin(F.broadcast(array)).select(id, t.joined(tokens, strip_rest=strip_rest).alias("text"))  # one row


#: Tokens of a vocabulary that is sent to all tasks.
MOST_TOKENS = 2_000_000
