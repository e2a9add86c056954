import random

import numpy as np
import pytest

from hushscan.llm import langid, packing, pieces
from hushscan.llm.common import Memo

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def unpacked(vocabulary, text):
    return np.frombuffer(vocabulary.encode([text], Memo(vocabulary.spaced))[0][0], vocabulary.kind).tolist()


def test_merge_pieces_equal_the_library(vocabulary, library):
    draw = random.Random(2)
    bits = ["the", "in", " ", "  ", "x", "é", "漢", "er", "a", " ", "ing", "\n", "ation", "0", "日本", "😀", "aaaa"]
    for _ in range(150):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 300)))
        assert unpacked(vocabulary, text) == library.encode(text)
        marked = "▁" + text.replace(" ", "▁")
        step = draw.randint(1, 40)
        streamed = [i for part in vocabulary.stream(marked[j : j + step] for j in range(0, len(marked), step)) for i in part]
        assert not text or streamed == library.encode(text)


def test_streaming_commits_before_the_end(vocabulary):
    read = []

    def source():
        for i in range(400):
            read.append(i)
            yield "▁there"

    assert next(vocabulary.stream(source())) and len(read) < 60


def test_decoding_is_lossless(vocabulary):
    for text in ["", " ", "  a", "a▁b", "▁", "\x00\t", "é́😀", "x" * 5000, " \n " * 50]:
        assert vocabulary.decode(unpacked(vocabulary, text)) == text


def test_unigram_pieces_against_the_whole_search():
    draw = random.Random(5)
    names = list("abcd") + ["".join(draw.choice("abcd") for _ in range(draw.randint(2, 6))) for _ in range(60)]
    names = ["<unk>"] + list(dict.fromkeys(names))
    scores = [0.0] + [-draw.uniform(1, 9) for _ in names[1:]]
    v = pieces.Vocabulary(names, scores, [0], [], 0, merges=False)
    for _ in range(60):
        text = "".join(draw.choice("abcdx") for _ in range(draw.randint(1, 200)))
        best, ways = [0.0], [[]]
        for end in range(1, len(text) + 1):
            options = [(best[s] + v.scores[v.ids[text[s:end]]], ways[s] + [v.ids[text[s:end]]]) for s in range(end) if text[s:end] in v.ids]
            options.append((best[end - 1] + v.floor, ways[end - 1] + [0])) if text[end - 1] not in v.ids else None
            top = max(options, key=lambda o: o[0])
            best.append(top[0]), ways.append(top[1])
        got = [i for part in v.stream(text[j : j + 7] for j in range(0, len(text), 7)) for i in part]
        assert got == ways[-1]


def test_words_searched_together_equal_words_alone(vocabulary):
    draw = random.Random(11)
    bits = ["the", "in", "▁", "x", "é", "漢", "er", "a", "ing", "\n", "ation", "0", "日本", "😀", "aaaa", "\x00", pieces._LITERAL]
    words = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    assert vocabulary.many(words) == [vocabulary.word(w) for w in words] and vocabulary.many([]) == []
    names = list("abcd") + ["".join(draw.choice("abcd") for _ in range(draw.randint(2, 6))) for _ in range(60)]
    names = ["<unk>"] + list(dict.fromkeys(names))
    v = pieces.Vocabulary(names, [-draw.uniform(1, 9) for _ in names], [0], [], 0, merges=False)
    words = ["".join(draw.choice("abcdx") for _ in range(draw.randint(1, 30))) for _ in range(500)]
    assert v.many(words) == [v.word(w) for w in words]


def test_encode_and_decode_tables(spark, vocabulary, library):
    rows = [(1, "Hello there", "k", 1), (2, None, "k", 1), (3, "", "k", 1), (None, "a▁b " * 3000, "k", 1), (1, "Hello there", "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n int")
    coded = pieces.encode_texts(df, vocabulary)
    got = {(r.doc_id, r.n_pieces): r for r in coded.collect()}
    assert got[1, len(library.encode("Hello there"))].ids == library.encode("Hello there")
    assert [r.ids for k, r in got.items() if k == (2, 0)] == [None] and got[3, 0].ids == []
    assert all(r.lossless is (None if r.ids is None else True) for r in got.values())
    back = sorted(((r.doc_id, r.decoded) for r in pieces.decode_ids(coded, vocabulary).collect()), key=str)
    assert back == sorted(((r[0], r[1]) for r in rows), key=str)
    assert pieces.encode_texts(df.limit(0), vocabulary).collect() == []


def test_best_fit_against_a_plain_search():
    draw = random.Random(1)
    for _ in range(100):
        lengths = [draw.randint(1, 64) for _ in range(draw.randint(1, 150))]
        rows = packing.best_fit(lengths, 64)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= 64 for r in rows)
        left = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in range(len(left)) if left[b] >= n]
            if fits:
                left[min(fits, key=lambda b: left[b])] -= n
            else:
                left.append(64 - n)
        assert sorted(left) == sorted(64 - sum(lengths[i] for i in r) for r in rows)


def test_packing_round_trip(spark, tmp_path):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["alpha", "beta", " ", "\n", "gam-ma", "é"]) for _ in range(draw.randint(0, 90))) for _ in range(60)]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(100, None, 1, "c"), (101, "", 1, "c"), (102, "word " * 9000, 1, "c"), (None, "x", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, row string").repartition(3)
    layout = packing.Layout(width=64, buffer_tokens=1500)
    packing.write_packed(packing.pack_documents(df, layout), str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    for r in packed.collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        want = [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
        assert positions.tolist() == want + [0] * (64 - r.n_tokens) and not ids[r.n_tokens :].any()
    assert packed.select("shard", "buffer", "row").distinct().count() == packed.count()
    import base64
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.RANKS, "rb"))}
    coding = packing.Tokeniser(ranks, public_tokenizers.PATTERN).coding
    found = {}
    for s in packing.unpack_documents(packed, layout).collect():
        found.setdefault(s.doc_id, []).append((s.start, s.ids))
    for doc, text, _, _ in rows:
        ids = [i for _, part in sorted(found.get(doc, [])) for i in part]
        assert ids == (coding.encode_ordinary(text) + [50256] if text else [])
    assert packing.pack_documents(df.limit(0), layout).collect() == []


def test_words_are_cut_where_the_tokenizer_cuts():
    import base64
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.RANKS, "rb"))}
    coding = packing.Tokeniser(ranks, public_tokenizers.PATTERN)
    draw = random.Random(8)
    for _ in range(300):
        text = "".join(draw.choice(["a", "bc", " ", "  ", "\n", "\t", "1", "'s", "é", "\x1c", "　", "."]) for _ in range(30))
        assert coding.encode(text).tolist() == coding.coding.encode_ordinary(text)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out("doc_id")), langid.Training(docs_per_language=100))
    told = langid.identify(docs, model).where(langid.held_out("doc_id")).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told) and len(told) > 20
    assert all(0 <= r.score <= 1 for r in told)


def test_language_edge_cases(spark):
    rows = [(i, f"das ist ein haus nummer {i}", "de") for i in range(20)] + [(50 + i, f"this is the house number {i}", "en") for i in range(20)]
    rows += [(98, None, "en"), (99, "the", None)]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(rows, schema))
    asked = [(1, None), (2, ""), (3, "12 + 3!"), (4, "This house"), (None, "Das Haus"), (5, "hauses numeros"), (6, "the house " * 40_000)]
    df = spark.createDataFrame([(i, t, "old", 9) for i, t in asked], "doc_id long, text string, lang_pred string, c0 int")
    told = langid.identify(df, model)
    assert told.columns == ["doc_id", "text", "c0", "lang_pred", "score"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in told.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[None][0] == "de" and got[6] == ("en", pytest.approx(1.0))
    assert got[5][0] in ("de", "en") and 0 < got[5][1] <= 1
    nothing = langid.fit(spark.createDataFrame([], schema))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).collect() == []


def test_backoff_takes_the_longest_known_grams(spark):
    rows = [(1, "abcde abcde", "x"), (2, "vwxyz", "y")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.cost("abcde").tolist() == [0.0, 7.0]
    long = model.cost("abcdq")  # of its grams of five only " abcd" is known
    assert long[0] == model.costs[model.ngrams[4][" abcd"]][0] and long[1] == 7.0
    assert model.cost("ÿ").tolist() == model.costs[[model.ngrams[0][" "]] * 2].mean(axis=0).tolist()


def test_number_signs_are_no_letters():
    model = langid.Model(["de", "en"], {}, [{} for _ in range(5)], np.zeros((0, 2), np.float32), langid.Training())
    for text in ("\u00bd \u00bd", "\u00b2", "\u2460\u2461", "\u2167", "12 _ \u0663"):
        assert model.predict(text) == (langid.UNKNOWN, 0.0)
    assert langid.words_of("Ab\u00bdc d\u2167 \u4e00\u00b2\u00e9") == ["ab", "c", "d", "\u4e00", "\u00e9"]


def test_portions_cover_all_rows_once():
    import pyarrow as pa

    for texts in ([], [None], ["abc"] * 5, [None, "x" * 9, "", "ab", None, "y" * 30, "c"], ["", ""]):
        got = list(langid.portions(pa.array(texts, pa.string()), most=10))
        assert [i for start, n in got for i in range(start, start + n)] == list(range(len(texts)))
        assert all(n == 1 or sum(len(t or "") for t in texts[start : start + n]) <= 10 for start, n in got)


def test_a_language_task_holds_little_at_once():
    import pyarrow as pa

    model = langid.Model(["en", "fr"], {"ab": 0}, [{}] * 5, np.array([[1, 2]], np.float32), langid.Training(remembered=50_000))
    texts = pa.array([" ".join(f"{at + i:x}" for i in range(10_000)) + " ab" for at in range(0, 600_000, 10_000)], pa.string())
    seen, most = [], 0
    for start, rows, best, score in langid.predictions(model, texts):
        assert texts.slice(start, rows).nbytes <= (1 << 20) + 8 * (rows + 1)
        seen += range(start, start + rows)
        assert len(best) == len(score) == rows and set(best) == {0}
        most = max(most, model.used)
    assert seen == list(range(60))
    assert most <= 50_000 + (1 << 20) // 4  # tokens of one portion on top
