"""BPE encoding with content-defined chunks, and decoding.

A rolling hash over the bytes cuts each text where its content says so; documents that
share passages so share chunks.  Documents are dealt out by the smallest hash at the end
of a chunk, which brings those that share chunks to one task, and a task encodes a chunk
once.  At each joint of two chunks the words around it are encoded again, in a window that grows
until its ids agree with those of the chunks on either side; where no window within the
two chunks agrees, the text is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

TOKENIZER = "word_bpe_49k.json"
#: Bytes that the rolling hash sees, and bits of it that are zero at a cut: chunks have about 2 ** CUT_BITS bytes.
WINDOW, CUT_BITS = 32, 10
#: Bytes of chunks, and words of a generation, that a Python worker remembers.
MEMO_BYTES, MEMO_WORDS = 16 << 20, 200_000
#: Longest word that is remembered.
LONGEST = 64

#: Blanks at which a text can be taken apart: the tokenizer drops them, and no token crosses them.
BLANK = re.compile("[ \n]")
#: A special token of the tokenizer: it stands between words that are encoded together.
MARK = "<|endoftext|>"
#: A word of small letters; and signs at a word's end, which the tokenizer takes together, apart from the letters before them.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
SIGNS = re.compile(r"(?<=[a-zß-öø-ÿ])([!-&(-/:;=-@\[-`{-~]+)(?= )")
#: How the last token of a word ends.
WORD_END = "</w>"
GEAR = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64)


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the rolling hash of the last WINDOW bytes ends in zeros, between code points, and the hashes there."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    h, span = GEAR[raw], 1
    while span < WINDOW:  # h covers ``span`` bytes: twice as many with the one before
        h[span:] += h[:-span].copy() << np.uint64(span)
        span *= 2
    mask = np.uint64((1 << CUT_BITS) - 1) << np.uint64(WINDOW)
    at = np.flatnonzero((h[WINDOW - 1 : -1] & mask) == 0) + WINDOW
    at = at[raw[at] & 0xC0 != 0x80]
    return at, h[at - 1]


def pieces(text: str) -> list[bytes]:
    """The chunks of a text, as bytes."""
    data = text.encode("utf-8", "surrogatepass")
    ends = [*boundaries(data)[0].tolist(), len(data)]
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True) if b > a]


def chunks(text: str) -> list[str]:
    return [p.decode("utf-8", "surrogatepass") for p in pieces(text)]


def place_of(text: str | None) -> int:
    """The smallest hash at a chunk's end: documents that share chunks tend to share it; a text of one chunk has its own hash."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass")
    found = boundaries(data)[1]
    return int(found.min()) if len(found) else xxhash.xxh64_intdigest(data)


def plainer(text: str) -> str:
    """A text that encodes to the same ids and has fewer different words: small letters, as the tokenizer makes them, and signs apart from words.

    Only texts of one-byte characters, whose small letters are single, and without special tokens are changed.
    """
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text if "<|" in text else SIGNS.sub(r" \1", text.lower())


@dataclass(frozen=True)
class Chunk:
    """What a chunk gives, whatever stands around it: the partial words at its edges, and all between its first and last blank encoded."""

    text: str
    head: str
    tail: str
    ids: bytes
    first: tuple[str, bytes]
    last: tuple[str, bytes]

    def words(self) -> list[str]:
        return [w for w in BLANK.split(self.text)[1:-1] if w]


class Words(dict):
    """Ids of words as bytes, in two generations: when the younger is full it becomes the older, which then goes."""

    def __init__(self, of: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.of, self.older = of, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            return self.of(word)
        self[word] = found
        return found

    def age(self) -> None:
        self.older = dict(self)
        self.clear()
        self[""] = b""


class Coder:
    """Encodes texts by chunks and decodes ids, with a bounded memory of chunks."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("only tokenizers that join their tokens by blanks are decoded here")
        self.tokens = pa.array([self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))])
        self.ends = np.array([t.as_py().endswith(WORD_END) for t in self.tokens])
        self.marks = np.arange(len(self.tokens)) == self.tokenizer.token_to_id(MARK)
        self.words = Words(lambda word: self.batch([word])[0])
        self.chunks: dict[str, Chunk] = {}
        self.held = self.encoded = self.reused = self.repaired = self.grown = self.whole = 0

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers, straight from the tokenizer."""
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text that each list of ids stands for: its tokens between blanks."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(tokens, " ")

    def learn(self, parts: list[list[str]]) -> None:
        """Encode the chunks that are new, each once, from the ids of their words."""
        if self.held > MEMO_BYTES:
            self.chunks, self.held = {}, 0
        new = list({c: None for own in parts for c in own if c not in self.chunks and BLANK.search(c)})
        flat = [c.replace("\n", " ") for c in new]
        inner = [c[c.index(" ") : c.rindex(" ") + 1] for c in flat]
        words = [plainer(i).split(" ") for i in inner]
        self.learn_words(set().union(*words))
        for chunk, c, i, w in zip(new, flat, inner, words, strict=True):
            ids, i = self.ids_of(w), i.strip(" ")
            first, last = i[: i.find(" ")] if " " in i else i, i[i.rfind(" ") + 1 :]
            self.chunks[chunk] = Chunk(chunk, c[: c.index(" ")], c[c.rindex(" ") + 1 :], ids, (first, self.ids_of(plainer(f"{first} ").split(" "))), (last, self.ids_of(plainer(f"{last} ").split(" "))))
            self.held += 2 * len(chunk) + len(ids) + 700
        self.encoded += len(new)

    def ids_of(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def learn_words(self, words: set[str]) -> None:
        """Encode new words, many at once: those of letters between blanks, others between marks that the tokenizer never merges with them."""
        if len(self.words) > MEMO_WORDS:
            self.words.age()
        young, old, plain = self.words, self.words.older, PLAIN.fullmatch
        kinds: tuple[list[str], list[str]] = ([], [])
        for w in words:
            if w not in young and w not in old and len(w) <= LONGEST and MARK not in w:
                kinds[plain(w) is None].append(w)
        for some, between, last in ((kinds[0], " ", self.ends), (kinds[1], MARK, self.marks)):
            for at in range(0, len(some), 2000):
                self.words.update(zip(some[at : at + 2000], self.split(between.join(some[at : at + 2000]), last), strict=True))

    def split(self, text: str, last: np.ndarray) -> list[bytes]:
        """The ids of each word of a text, of which the ids in ``last`` are the ends; marks between words go."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        data, ends = ids.tobytes(), np.flatnonzero(last[ids])
        if last is self.ends:
            stops = (4 * (ends + 1)).tolist()
            return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        ends = ends.tolist()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]

    def repair(self, left: Chunk | None, joint: str, right: Chunk | None, a: bytes, b: bytes) -> tuple[bytes, bytes, bytes] | None:
        """The ids before, of and after a joint; None if no window within the two chunks agrees with what lies outside it.

        The window has ``k`` whole words on either side.  It agrees if it begins and ends
        with the ids of its outermost words and the chunks have the same ids there.
        """
        before, after = left.words() if left else [], right.words() if right else []
        k = 1
        while True:
            m, n = max(0, len(before) - k), min(k, len(after))
            keep, outer, inner, then, window = self.batch([" ".join(x) for x in (before[: m + 1], before[m : m + 1], after[n - 1 : n] if n else [], after[n - 1 :] if n else [], [*before[m:], joint, *after[:n]])])
            if a.startswith(keep) and keep.endswith(outer) and b.endswith(then) and then.startswith(inner) and agrees(outer, window, inner):
                return keep, window[len(outer) : len(window) - len(inner)], then
            if k >= max(len(before), len(after)):
                return None
            k *= 2

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text, as lists."""
        parts, known, uses = [chunks(t or "") for t in texts], self.encoded, 0
        self.learn(parts)
        lines: list[list[Chunk | str]] = []  # joints and chunks in turn, beginning and ending with a joint
        for own in parts:
            line: list[Chunk | str] = [""]
            for part in own:
                chunk = self.chunks.get(part)
                if chunk is None:  # no blank, so no whole word ends here: the joint grows over this chunk
                    line[-1] += part
                else:
                    line[-1] += chunk.head
                    line += [chunk, chunk.tail]
                    uses += 1
            lines.append(line)
        self.reused += uses - (self.encoded - known)
        windows = self.batch([f"{line[i - 1].last[0] if i else ''} {line[i]} {line[i + 1].first[0] if i + 1 < len(line) else ''}" for line in lines for i in range(0, len(line), 2)])
        found, at = [], 0
        for text, line in zip(texts, lines, strict=True):
            out = [x.ids if isinstance(x, Chunk) else windows[at + i // 2] for i, x in enumerate(line)]
            for i in range(0, len(line), 2):
                left, right = line[i - 1] if i else None, line[i + 1] if i + 1 < len(line) else None
                outer, inner = left.last[1] if left else b"", right.first[1] if right else b""
                self.repaired += 1
                if agrees(outer, out[i], inner) and (not left or out[i - 1].endswith(outer)) and (not right or out[i + 1].startswith(inner)):
                    out[i] = out[i][len(outer) : len(out[i]) - len(inner)]
                    continue
                self.grown += 1
                fixed = self.repair(left, line[i], right, out[i - 1] if left else b"", out[i + 1] if right else b"")
                if fixed is None:
                    self.whole += 1
                    out = self.batch([text])
                    break
                out[i] = fixed[1]
                if left:
                    out[i - 1] = fixed[0]
                if right:
                    out[i + 1] = fixed[2]
            at += (len(line) + 1) // 2
            found.append(b"".join(out))
        ends = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def agrees(before: bytes, window: bytes, after: bytes) -> bool:
    """Whether a window begins and ends with the ids of its outermost words."""
    return len(window) >= len(before) + len(after) and window.startswith(before) and window.endswith(after)


_coders: dict[str, Coder] = {}


def coder(name: str = TOKENIZER) -> Coder:
    if name not in _coders:
        _coders[name] = Coder(name)
    return _coders[name]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, ids, decoded`` for every row of ``docs``.

    ``ids`` are those of the tokenizers library without special tokens added, ``decoded``
    is its decoding of them.  Null texts count as empty: no ids.  Repeated rows and null
    ids keep their rows; very long texts are many chunks; other columns are ignored; an
    empty table gives an empty result.  The shuffle is a rebalance, which splits the
    partition of a chunk that very many documents share.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def placed(batch: pa.RecordBatch) -> dict:
        place = np.array([place_of(t) for t in batch.column(1).to_pylist()], np.uint64)
        return {"id": batch.column(0), "text": batch.column(1), "place": pa.array(place.view(np.int64))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                ids = own.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "ids": ids, "decoded": own.decode(ids)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = map_arrow(rows, placed, f"id {kind}, text string, place long").hint("rebalance", "place")
    return dealt.select("id", "text").mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
