"""SentencePiece encoding and decoding with a given piece table.

Texts are cut into words: a run of word marks and what follows up to the next mark; no piece crosses such a cut.
The most frequent words of the corpus are encoded relationally: their substrings of bounded length are exploded
and equi-joined to the piece table, the edges are grouped by word, and a higher-order fold finds the path. For a
model whose pieces are merges (BPE) the best path by summed score is not the encoding; the fold takes the edge of
highest score, leftmost of equals, whose ends are boundaries with one boundary between, and removes that one,
until no edge is left. It gives what the merges give. For a unigram model it is the Viterbi path.

The words so encoded (at most `LEXICON`) go to the tasks, which look words up and encode any other word by the
same rule. So every word of every whole text is encoded, and the lexicon decides only where that is done.

Defined results: a null text has null ids and a null decoded text; an empty text no ids; characters outside the
table become byte pieces; a literal word mark in a text is encoded as a space; all columns of the input are kept,
and `token_ids` (or `decoded`) replaces a column of that name.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import stage

MARK = "▁"
WORD = f"{MARK}*[^{MARK}]+|{MARK}+"
#: The same without the first mark of each, for texts that begin with one: then every word does.
BARE = re.compile(f"{MARK}({MARK}*[^{MARK}]+|{MARK}*)")
#: Words encoded relationally, and their greatest length.
LEXICON, LENGTH = 65_536, 32
#: Characters up to which a word is merged by scanning its pairs.
SHORT = 48
#: Words that a task remembers.
REMEMBER = 300_000
#: Rows that a task encodes, or decodes, at a time.
ROWS = 1000


@dataclass(frozen=True)
class Pieces:
    """Piece strings by id, their scores, the ids of byte pieces by byte, and the kinds without text."""

    text: tuple[str, ...]
    score: tuple[float, ...]
    byte_ids: tuple[int, ...]
    silent: frozenset[int]
    unknown: int
    unigram: bool

    @staticmethod
    def load(path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            data = f.read()
        spec = pb.ModelProto()
        spec.ParseFromString(data)
        if spec.normalizer_spec.name != "identity" or not spec.normalizer_spec.add_dummy_prefix or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only tables with the identity normaliser and a leading mark are supported")
        p = SentencePieceProcessor(model_proto=data)
        n = range(p.get_piece_size())
        bytes_ = {p.id_to_piece(i): i for i in n if p.is_byte(i)}
        byte_ids = tuple(bytes_[f"<0x{b:02X}>"] for b in range(256)) if bytes_ else ()
        silent = frozenset(i for i in n if p.is_control(i))
        return Pieces(tuple(map(p.id_to_piece, n)), tuple(map(p.get_score, n)), byte_ids, silent, p.unk_id(), spec.trainer_spec.model_type == 1)

    @cached_property
    def normal(self) -> dict[str, int]:
        other = self.silent | {self.unknown} | set(self.byte_ids)
        return {t: i for i, t in enumerate(self.text) if i not in other}

    @cached_property
    def cost(self) -> dict[str, float]:
        return {t: -self.score[i] for t, i in self.normal.items()}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.normal))

    def spell(self, char: str) -> list[int]:
        """Ids of a character outside the table."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        ids = self.normal
        whole = _viterbi(word, self) if self.unigram else _merged(word, self.cost) if len(word) > SHORT else _merged_short(word, self.cost)
        return [i for p in whole for i in ([ids[p]] if p in ids else self.spell(p))]

    @cached_property
    def raw(self) -> pa.Array:
        """The bytes that each id stands for."""
        values = [b"" if i in self.silent else " \u2047 ".encode() if i == self.unknown else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        for byte, i in enumerate(self.byte_ids):
            values[i] = bytes([byte])
        return pa.array(values, pa.binary())

    def decode(self, tokens: pa.ListArray) -> pa.Array:
        """Texts of lists of ids; bytes that are no UTF-8 become replacement characters."""
        flat = self.raw.take(tokens.flatten())
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, flat), b"")
        joined = pc.replace_substring_regex(joined, "^ ", "", max_replacements=1)
        try:
            out = joined.cast(pa.string())
        except pa.ArrowInvalid:
            out = pa.array([x.as_py().decode("utf-8", "replace") for x in joined], pa.string())
        return pc.if_else(tokens.is_valid(), out, None)


def _merged_short(word: str, cost: dict[str, float]) -> list[str]:
    """Pieces of a word by merging the best neighbours, leftmost of equals, until none make a piece."""
    part, get = list(word), cost.get
    pair = [get(a + b, math.inf) for a, b in zip(part, part[1:])]
    while pair and (best := min(pair)) < math.inf:
        i = pair.index(best)
        p = part[i] + part[i + 1]
        part[i : i + 2] = [p]
        del pair[i]
        if i:
            pair[i - 1] = get(part[i - 1] + p, math.inf)
        if i < len(pair):
            pair[i] = get(p + part[i + 1], math.inf)
    return part


def _merged(word: str, cost: dict[str, float]) -> list[str]:
    """The same for long words, in n log n."""
    n = len(word)
    part: list[str] = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(cost[p], i, p) for i in range(n - 1) if (p := part[i] + part[i + 1]) in cost]
    heapq.heapify(heap)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = after[i]
        if not part[i] or j >= n or part[i] + part[j] != p:
            continue
        part[i], part[j] = p, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := p + part[k]) in cost:
                heapq.heappush(heap, (cost[q], i, q))
        if (h := before[i]) >= 0 and (q := part[h] + p) in cost:
            heapq.heappush(heap, (cost[q], h, q))
    return [p for p in part if p]


def _viterbi(word: str, pieces: Pieces) -> list[str]:
    ids, low = pieces.normal, min(pieces.score) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        steps = [(best[s][0] + pieces.score[ids[word[s:e]]], s) for s in range(max(0, e - pieces.longest), e) if word[s:e] in ids]
        best.append(max(steps or [(best[e - 1][0] + low, e - 1)]))
    out, e = [], len(word)
    while e:
        out.append(word[best[e][1] : e])
        e = best[e][1]
    return out[::-1]


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON) -> DataFrame:
    """The words that occur most often in docs, at most limit, among those short enough for the relational lattice."""
    marked = F.concat(F.lit(MARK), F.replace(F.col(text), F.lit(" "), F.lit(MARK)))
    words = docs.where(F.length(text) > 0).select(F.explode(F.regexp_extract_all(marked, F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.where(F.length("word") <= LENGTH).groupBy("word").count().where("count > 1")
    level = F.floor(F.log2("count") * 64)
    counted = stage(counted.select("word", level.alias("level")), "lattice-counts")
    # words by level of frequency: a few thousand rows whatever the corpus; no sort of all words
    least, room = None, limit
    for r in sorted(counted.groupBy("level").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return counted.where(F.lit(False) if least is None else F.col("level") >= least).select("word")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words: different words of at most LENGTH characters. (word, ids) for those whose characters are all pieces."""
    spark = words.sparkSession
    table = [(t, i, -pieces.score[i]) for t, i in pieces.normal.items()]
    known = F.broadcast(spark.createDataFrame(table, "piece string, id int, cost double"))  # as many rows as the model has pieces
    size = F.length("word")
    starts = words.withColumn("s", F.explode(F.sequence(F.lit(0), size - 1)))
    spans = starts.withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + pieces.longest, size))))
    edges = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)")).join(known, "piece")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x)
    ends, inner = bit(F.col("s")) + bit(F.col("e")), bit(F.col("e")) - bit(F.col("s") + 1)
    edge = F.struct("cost", "s", "e", "id", ends.alias("ends"), inner.alias("inner"))
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    single = F.size(F.filter("edges", lambda x: x["e"] - x["s"] == 1))
    grouped = grouped.where(single == size)
    if pieces.unigram:
        return _paths(grouped)

    def step(mask, _):
        free = lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1)
        best = F.get(F.filter("edges", free), F.lit(0))
        return F.coalesce(mask.bitwiseAND(F.bitwise_not(best["inner"])), mask)

    everywhere = bit(size + 1) - 1
    cut = grouped.withColumn("mask", F.aggregate(F.sequence(F.lit(1), size), everywhere, step))
    inside = F.filter("edges", lambda x: (F.col("mask").bitwiseAND(x["ends"]) == x["ends"]) & (F.col("mask").bitwiseAND(x["inner"]) == 0))
    path = F.array_sort(F.transform(inside, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))))
    return cut.select("word", F.transform(path, lambda x: x["id"]).alias("ids"))


def _paths(grouped: DataFrame) -> DataFrame:
    """Viterbi: the fold keeps for every end reached so far the least cost and its path."""
    reach = "array<struct<e:int,cost:double,ids:array<int>>>"
    start = F.array(F.struct(F.lit(0).alias("e"), F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("ids"))).cast(reach)
    ordered = F.array_sort(F.transform("edges", lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["cost"].alias("cost"), x["id"].alias("id"))))

    def step(done, x):
        back = F.get(F.filter(done, lambda d: d["e"] == x["s"]), F.lit(0))
        here = F.struct(x["e"].alias("e"), (back["cost"] + x["cost"]).alias("cost"), F.concat(back["ids"], F.array(x["id"])).alias("ids"))
        old = F.get(F.filter(done, lambda d: d["e"] == x["e"]), F.lit(0))
        rest = F.filter(done, lambda d: d["e"] != x["e"])
        return F.when(old.isNull() | (old["cost"] > here["cost"]), F.concat(rest, F.array(here)).cast(reach)).otherwise(done)

    last = F.aggregate(ordered, start, step, lambda done: F.get(F.filter(done, lambda d: d["e"] == F.length("word")), F.lit(0))["ids"])
    return grouped.select("word", last.alias("ids"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches in smaller parts, so that the ids of few texts are held at once."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def _bare_words(text: str) -> list[str]:
    """The words of a text that is not empty, without the first mark of each."""
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return BARE.findall(MARK + text.replace(" ", MARK))
    return text.split(" ")


class _Ids(dict):
    """Ids of words without their first mark, as the bytes of 32-bit numbers; other words are encoded as they are met."""

    def __init__(self, known: dict[str, bytes], pieces: Pieces):
        super().__init__(known)
        self.pieces = pieces

    def __missing__(self, bare: str) -> bytes:
        made = array("i", self.pieces.encode_word(MARK + bare)).tobytes()
        if len(bare) < LENGTH:
            self[bare] = made
        return made


def _rename(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name) if name in df.columns else df


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """docs with token_ids."""
    words = stage(frequent_words(docs, text, lexicon), "lattice-words")
    paths = stage(lattice(words, pieces), "lattice-paths").collect()  # at most `lexicon` rows
    known = {r.word[1:]: array("i", r.ids).tobytes() for r in paths}
    docs = _rename(docs, "token_ids")
    at, names = docs.columns.index(text), [*docs.columns, "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(known, pieces)
        for b in _slices(batches):
            if len(ids) > len(known) + REMEMBER:
                ids = _Ids(known, pieces)
            flat, ends, missing = [], [0], []
            for x in b.column(at):
                t = x.as_py()
                missing.append(t is None)
                found = b"".join(map(ids.__getitem__, _bare_words(t))) if t else b""
                flat.append(found)
                ends.append(ends[-1] + len(found) // 4)
            numbers = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(flat))])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers, mask=pa.array(missing, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))


def decode(rows: DataFrame, pieces: Pieces, ids: str = "token_ids") -> DataFrame:
    """rows with decoded, the text of their ids."""
    rows = _rename(rows, "decoded")
    at, names = rows.columns.index(ids), [*rows.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pieces.decode(b.column(at))], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def load(spark: SparkSession, path: str | None = None) -> Pieces:
    """The piece table of a model file; by default the 32k BPE table of the public tokenizers' folder."""
    return Pieces.load(path or spark.conf.get("palimpsest.pieces", "/opt/tokenizers/piece_bpe_32k.model"))
