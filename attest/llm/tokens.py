"""Token ids of whole texts as ORC files.

Documents are dealt by ranges of doc_id, a file each, ordered and encoded there, and written by Spark's
ORC writer: integers are run-length encoded in stripes, every ROW_INDEX rows have an index entry, and
doc_id has a Bloom filter. Readers take stripes in parallel; a filter on doc_id skips stripes and rows
by their statistics and filters (``lookup``).

Encoding with a cache: the pre-tokenizer of a byte-level vocabulary always cuts before a space that
has no white space on both sides, so a text is split at spaces, and a piece that came before is looked
up. A new piece is cut into words by the pre-tokenizer's own pattern, and only words that are new are
encoded. A text with a space between white space is cut by the pattern at once; pieces with characters
whose classes differ between versions of Unicode, and texts that name a special token, are encoded as
they are. The ids are those of the whole text in every case. What a worker keeps is bounded in
characters and ids (KEPT): beyond, the older half is let go.

Defined results: a null or empty text has the end id only; rows of equal doc_id lie next to one
another, by text; null ids come first; an empty table gives an empty file.
"""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import few_parts, new_folder, parts_of, range_bounds, range_of, written

END = 2
#: Bytes of the input's files that a file of ids holds, in the mean.
RANGE_BYTES = 128 << 20
ROW_INDEX = 1000
STRIPE = 16 << 20
#: Run-length encoded ids hardly shrink further; this is for what little does.
COMPRESS = "LZ4"
#: Characters of pieces, and ids, of each of the two halves that a worker keeps.
KEPT = 9_000_000
#: Words that are encoded in one call.
LINES = 1024

_BEFORE_WHITE = re.compile(r" \s")
_AMID_WHITE = re.compile(r"\s \s")
#: The pattern of byte-level vocabularies (a fixed value).
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that not all engines put in the same class.
_UNSURE = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]")


def _amid_white(text: str) -> bool:
    """Whether a space has white space on both sides."""
    return _BEFORE_WHITE.search(text) is not None and ("  " in text or _AMID_WHITE.search(text) is not None)


def _key(word: str) -> str:
    """Under which name a word is kept: without its leading space, or with one if it has none; white space with a zero in front."""
    if word[0] != " ":
        return " " + word
    return "\0" + word if word[1:2].isspace() else word[1:]


def _word(key: str) -> str:
    return key[1:] if key[:1] == " " or key[:2] == "\0 " else " " + key


class _Numbers(dict):
    """Number by key; -1 for others, which ``in`` and ``get`` don't see."""

    def __missing__(self, key: str) -> int:
        return -1


class _Kept:
    """Ids by key, in one array."""

    def __init__(self):
        self.number = _Numbers()
        self.flat = np.zeros(1 << 16, "int32")
        self.start, self.size = np.zeros(1 << 14, "int64"), np.zeros(1 << 14, "int64")
        self.used = self.chars = 0

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """keys: new and distinct; ids: those of all keys; sizes: how many each key has."""
        at, need = len(self.number), self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, "int32")])
        if at + len(keys) > len(self.start):
            more = np.zeros(at + len(keys), "int64")
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.flat[self.used : need] = ids
        self.size[at : at + len(keys)] = sizes
        self.start[at : at + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.number.update(zip(keys, range(at, at + len(keys)), strict=True))
        self.used, self.chars = need, self.chars + sum(map(len, keys))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of entries, in order, and how many each has."""
        size = self.size[at]
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[at] - begin, size) + np.arange(int(size.sum()))], size

    def full(self) -> bool:
        return max(self.used, self.chars) > KEPT


class Encoder:
    """Ids of texts by one tokenizer file."""

    _open: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same vocabulary for words that are cut already, one a line; ASCII letters stand for their bytes.
        self.lines, self.ascii = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.ascii.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([self.ascii.pre_tokenizer, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # A token has a letter for each of its bytes.
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        self.kept, self.old = _Kept(), _Kept()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "int32") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add_whole(self, keys: list[str]) -> None:
        if keys:
            ids = self.whole([_word(k) for k in keys])
            self.kept.add(keys, np.concatenate(ids), np.array(list(map(len, ids))))

    def _learn_words(self, keys: list[str]) -> None:
        """Keys of single words: those with and those without a leading space, many in one call."""
        self._add_whole([k for k in keys if k[:2] == "\0 " or "\n" in k])
        keys = [k for k in keys if k[:2] != "\0 " and "\n" not in k]
        plain = [k for k in keys if k.isascii() and k.isalpha()]
        self._learn_lines(plain, plain, "Ġ", self.ascii)
        rest = [k for k in keys if not (k.isascii() and k.isalpha())]
        self._learn_lines(*[[k for k in rest if k[:1] != " "]] * 2, " ", self.lines)
        rest = [k for k in rest if k[:1] == " "]
        self._learn_lines(rest, [k[1:] for k in rest], "", self.lines)

    def _learn_lines(self, keys: list[str], texts: list[str], lead: str, tokenizer) -> None:
        """Words that are texts with the same lead."""
        for i in range(0, len(keys), LINES):
            text = lead + ("\n" + lead).join(texts[i : i + LINES])
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "int32")
            # A word ends where its bytes do; the breaks between words have no token, and Ġ stands for one byte.
            raw = np.frombuffer((text.replace("Ġ", " ") if tokenizer is self.ascii else text).encode("utf-8"), "uint8")
            stop = np.append(np.flatnonzero(raw == 10), len(raw))
            stop -= np.arange(len(stop))
            self.kept.add(keys[i : i + LINES], ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), stop) + 1, prepend=0))

    def _learn(self, keys: list[str]) -> None:
        """Keys of pieces that are not kept."""
        old = self.old.number
        if old:
            at = np.fromiter(map(old.__getitem__, keys), "int64", len(keys))
            known = [k for k, x in zip(keys, at.tolist(), strict=True) if x >= 0]
            if known:
                self.kept.add(known, *self.old.take(at[at >= 0]))
                keys = [k for k, x in zip(keys, at.tolist(), strict=True) if x < 0]
        words, longer, cut, odd = [], [], [], []
        for k in keys:
            if not (k.isascii() and k.isprintable()) and _UNSURE.search(k):
                odd.append(k)
            elif k.isalpha():
                words.append(k)
            elif k[:-1].isalpha() and k[-1] in ",.;:!?":
                longer.append(k)
                cut.append([k[:-1], " " + k[-1]])
            elif len(found := _WORD.findall(_word(k))) == 1:
                words.append(k)
            else:
                longer.append(k)
                cut.append(list(map(_key, found)))
        self._add_whole(odd)
        self._learn_words(words)
        number = self.kept.number
        if longer:
            parts = list(itertools.chain.from_iterable(cut))
            self._learn([w for w in set(parts) if w not in number])
            ids, sizes = self.kept.take(np.array([number[w] for w in parts]))
            first = np.cumsum([0, *map(len, cut[:-1])])
            self.kept.add(longer, ids, np.add.reduceat(sizes, first))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each followed by END, and where each text's begin (with the end)."""
        if self.kept.full():
            self.old, self.kept = self.kept, _Kept()
        keys, counts, odd = [], [], []
        for k, text in enumerate(texts):
            before = len(keys)
            if "<|" in text or (amid := _amid_white(text)) and _UNSURE.search(text):
                odd.append(k)
            elif amid:
                keys += map(_key, _WORD.findall(text))
            elif text:
                head, *tail = text.split(" ")
                if head:
                    keys.append(" " + head)
                keys += tail
            counts.append(len(keys) - before)
        at = np.fromiter(map(self.kept.number.__getitem__, keys), "int64", len(keys))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list({keys[i] for i in missing}))
            at[missing] = [self.kept.number[keys[i]] for i in missing]
        found, size = self.kept.take(at)
        bound = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)]).astype("int64")]
        whole = dict(zip(odd, self.whole([texts[k] for k in odd]), strict=True)) if odd else {}
        parts = []
        for k in range(len(texts)):
            parts += [whole[k] if k in whole else found[bound[k] : bound[k + 1]], np.array([END], "int32")]
        out = np.concatenate(parts) if parts else np.zeros(0, "int32")
        starts = np.zeros(len(texts) + 1, "int64")
        np.cumsum([len(parts[2 * k]) + 1 for k in range(len(texts))], out=starts[1:])
        return out, starts


def write(docs: DataFrame, tokenizer: str) -> str:
    """Documents with doc_id and text -> a folder of ORC files: doc_id, part, pos, ids."""
    folder = new_folder(docs.sparkSession, "tokens")

    def encode(batches):
        pos, encoder = 0, Encoder.of(tokenizer)
        for batch in batches:
            texts, done = [x or "" for x in batch.column("text").to_pylist()], 0
            for n in parts_of(list(map(len, texts))):
                ids, starts = encoder.encode(texts[done : done + n])
                ids = pa.ListArray.from_arrays(pa.array(starts.astype("int32")), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, n), batch.column("part").slice(done, n), pa.array(np.arange(pos, pos + n)), ids], names=["doc_id", "part", "pos", "ids"])
                pos, done = pos + n, done + n

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = few_parts(docs, "text", RANGE_BYTES)
    part = range_of(F.col("doc_id"), range_bounds(docs.select("doc_id"), "doc_id", n))
    ordered = docs.withColumn("part", part).repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "text")
    encoded = ordered.mapInArrow(encode, "doc_id long, part int, pos long, ids array<int>")
    encoded.write.options(**{"orc.compress": COMPRESS, "orc.bloom.filter.columns": "doc_id", "orc.row.index.stride": str(ROW_INDEX), "orc.stripe.size": str(STRIPE)}).orc(folder)
    return folder


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, pos long, ids array<int>").orc(folder)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; stripes whose statistics or Bloom filters exclude them are not read."""
    return _files(spark, folder).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def sums(batches):
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("pos"), pa.array(np.diff(at).astype("int64")), pa.array(crc, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    rows = _files(spark, folder).mapInArrow(sums, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    rows = written(rows, "token-counts")
    # A row per file: what all files before it hold.
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(files, "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
