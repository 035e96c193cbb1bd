import random

import pyarrow as pa
import pytest
import sentencepiece

from palimpsest.llm import sentencepiece_lattice as L

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    return L.Pieces.load(PATH)


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    alphabet = "aaabcdefghijklmnopqrstuvwxyz     \n\té€😀ñß.,;---===1234567890ABCDEF日本"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    return [*out, "", " ", "   ", " a", "a ", "\n", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 70, " " * 40, "the representation of responsibility " * 3, "x" * 5000, "\x00\x01"]


def test_words_are_encoded_and_decoded_as_by_the_library(pieces, theirs):
    import re

    for t in texts():
        ids = [i for w in re.findall(L.WORD, L.MARK + t.replace(" ", L.MARK)) for i in pieces.encode_word(w)] if t else []
        assert ids == theirs.encode(t), t
        assert pieces.decode(pa.array([ids, None, []], pa.list_(pa.int32()))).to_pylist() == [t, None, ""]
    bad = [pieces.byte_ids[0xC3], pieces.byte_ids[0x28]]
    assert pieces.decode(pa.array([bad], pa.list_(pa.int32()))).to_pylist() == [theirs.decode(bad)]


def test_both_ways_to_merge_agree(pieces):
    rng = random.Random(5)
    for _ in range(300):
        w = L.MARK + "".join(rng.choice("aaeeinrstolhdu▁-=1") for _ in range(rng.randint(0, 60)))
        assert L._merged(w, pieces.cost) == L._merged_short(w, pieces.cost)


def test_relational_lattice_equals_the_library(spark, pieces, theirs):
    words = sorted({w for t in texts() for w in t.split() if len(w) <= L.LENGTH - 1})
    df = spark.createDataFrame([(L.MARK + w,) for w in words], "word string")
    got = {r.word: r.ids for r in L.lattice(df, pieces).collect()}
    for w in words:
        if all(c in pieces.normal for c in w):
            assert got[L.MARK + w] == theirs.encode(w)
        else:
            assert L.MARK + w not in got


def test_documents(spark, pieces, theirs):
    rows = [(i, t, "old") for i, t in enumerate(texts())] + [(None, None, "old"), (3, texts()[3], "old")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded string")
    out = L.decode(L.encode(docs, pieces, lexicon=50), pieces).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.token_ids == (None if r.text is None else theirs.encode(r.text)) and r.decoded == r.text
    assert L.encode(docs.where("false"), pieces).count() == 0


def test_viterbi_fold_equals_the_python_path(spark):
    made = L.Pieces(("<unk>", "a", "b", "c", "ab", "bc", "abc", "ca"), (0, -3.0, -3.1, -3.2, -4.0, -3.5, -7.5, -5.0), (), frozenset(), 0, True)
    words = ["abc", "abcabc", "caab", "a", "cccc", "bcabcaab"]
    got = {r.word: r.ids for r in L.lattice(spark.createDataFrame([(w,) for w in words], "word string"), made).collect()}
    assert got == {w: made.encode_word(w) for w in words}


def test_batches_are_worked_off_in_parts():
    import pyarrow as pa

    from palimpsest.llm import sentencepiece_lattice as L

    rows = pa.RecordBatch.from_pydict({"text": [f"a text {i}" if i % 7 else None for i in range(2500)]})
    parts = list(L._slices([rows]))
    assert [p.num_rows for p in parts] == [1000, 1000, 500] and pa.Table.from_batches(parts).to_pydict() == rows.to_pydict()
    pieces = L.Pieces.load("/opt/tokenizers/piece_bpe_32k.model")
    texts = ["one", None, "", "two words", "drei Wörter ß"]
    ids = pa.array([None if t is None else [i for w in ("▁" + t.replace(" ", "▁")).replace("▁", " ▁").split() for i in pieces.encode_word(w)] if t else [] for t in texts], pa.list_(pa.int32()))
    assert pieces.decode(ids.slice(2)).to_pylist() == texts[2:] and pieces.decode(ids.slice(1, 3)).to_pylist() == texts[1:4]


def test_words_are_kept_as_bytes_and_cut_as_by_the_pattern(pieces):
    import re
    import tracemalloc

    for t in [t for t in texts() if t] + ["a▁b ▁c", "▁", "a ▁", "one two  three ", " x"]:
        assert [L.MARK + w for w in L._bare_words(t)] == re.findall(L.WORD, L.MARK + t.replace(" ", L.MARK)), t
    ids, words = L._Ids({}, pieces), [f"wörd{i}" for i in range(20_000)]
    assert pa.array([list(memoryview(ids["words"]).cast("i"))]).to_pylist() == [pieces.encode_word("▁words")]
    tracemalloc.start()
    for w in words:
        ids[w]
    assert tracemalloc.get_traced_memory()[0] < 200 * len(words)
    tracemalloc.stop()
    ids["x" * L.LENGTH]
    assert "x" * L.LENGTH not in ids and len(ids) == len(words) + 1


def test_the_query_runs_in_light_batches(spark):
    """What it returns is staged, as its caller's batches are 64 MB."""
    from palimpsest.llm import op04

    out = op04.query(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString() and out.where("round_trip").count() > 0
