"""Toxicity, language and quality: accuracy on rows kept apart, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.helpers import crc_fold, documents, empty, odd

from tickerloom.llm import common, language, quality, toxicity

SF = "/root/testdata/sf0.01"


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_folds(spark):
    rows = spark.createDataFrame([(k,) for k in range(60)] + [(None,)], "doc_id long").select("doc_id", common.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (crc_fold(r.doc_id) == 1) for r in rows)


def test_word_hashes_tell_words_apart():
    texts = ["Ab aB ab\tcd\ncd", "", "ab", "x" * 50, "é É"]
    data, offsets = common.buffers(pa.array(texts))
    found = common.Words(data, offsets)
    assert np.diff(found.first).tolist() == [5, 0, 1, 1, 2]
    h = found.hash
    assert h[0] == h[1] == h[2] == h[5] and h[3] == h[4] and len(set(h.tolist())) == 5
    assert list(common.blocks(offsets, 10)) == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_toxicity_on_rows_kept_apart(spark):
    rows = {r.doc_id: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    truth = common.read(spark, SF, "labels").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (crc_fold(r.doc_id) == 1) for r in rows.values())
    toxic = [rows[t.doc_id].score for t in truth if t.toxic and rows[t.doc_id].held_out]
    plain = [rows[t.doc_id].score for t in truth if not t.toxic and rows[t.doc_id].held_out]
    assert np.mean([a > b for a in toxic for b in plain]) > 0.93  # area under the curve, from a few toxic rows
    assert np.mean(np.array(plain) < 0.7) > 0.97


def by_rule(texts, sample):
    """log P_toxic / P_ordinary of an expression, from the definitions: `texts` is the corpus, `sample` pairs of (toxic, text)."""
    order = toxicity.ORDER

    def expressions(text):
        return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())

    line = [b"\x01" * order + w + b"\x02" for w in {w for t in texts for w in expressions(t)}]
    grams = {order + 1: Counter(s[k - order : k + 1] for s in line for k in range(order, len(s)))}
    for size in range(order, 0, -1):
        grams[size] = Counter(g[1:] for g in grams[size + 1])

    def shared(window):
        if not window:
            return 1 / 256
        found = grams[len(window)]
        once, twice = (sum(n == k for n in found.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        after = [n for g, n in found.items() if g[:-1] == window[:-1]]
        return (max(found[window] - d, 0) + d * len(after) * shared(window[1:])) / sum(after)

    counts = [Counter(), Counter()]
    for toxic, text in sample:
        for w in set(expressions(text)):
            counts[0 if toxic else 1].update((w + b"\x02")[: k + 1] for k in range(len(w) + 1))
    discount = {0: 0.0, 1: toxicity.DISCOUNTS[0], 2: toxicity.DISCOUNTS[1]}

    def ratio(word):
        out, whole = 0.0, word + b"\x02"
        for k in range(len(whole)):
            gram, p = whole[: k + 1], []
            rest = []
            for c in counts:
                after = [n for g, n in c.items() if len(g) == k + 1 and g[:-1] == gram[:-1]]
                left = sum(discount.get(n, toxicity.DISCOUNTS[2]) for n in after) / sum(after) if after else 1.0
                own = (c[gram] - discount.get(c[gram], toxicity.DISCOUNTS[2])) / sum(after) if after else 0.0
                p.append((own, left))
                rest.append(left)
            if all(c[gram] == 0 for c in counts):
                out += np.log(rest[0] / rest[1])
            else:
                s = shared((b"\x01" * order + gram)[-order - 1 :])
                out += np.log((p[0][0] + p[0][1] * s) / (p[1][0] + p[1][1] * s))
        return out

    return expressions, ratio


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(8)
    parts = ["ab", "abc", "Abandon", "straße", "STRASSE", "é", "бес", "12", "idle", "idol", "x" * 30, "x" * 29 + "y", "internationalisation", "internationalism"]
    texts = [" ".join(rng.choice(parts) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = documents(spark, [(k, t, None, None) for k, t in enumerate(texts)] + [(99, None, None, None)])
    sample = [(k % 3 == 0, t) for k, t in enumerate(texts[:40])]
    rows = documents(spark, [(k, t, None, None) for k, (_, t) in enumerate(sample)]).selectExpr("doc_id % 3 = 0 AS toxic", "text")
    grams = toxicity.steps(toxicity.class_counts(rows), toxicity.backoff(toxicity.windows(docs)))
    model = toxicity.Model(*toxicity._sorted(grams.select("own", "ratio")), *toxicity._sorted(grams.select("history", "rest").distinct()))
    expressions, ratio = by_rule(texts, sample)
    every = sorted({w for t in [*texts, "abandonment never seen", "xxxxy 12345 ÉÉ"] for w in expressions(t)})
    data, offsets = common.buffers(pa.array([w.decode() for w in every]))
    assert model.words(data, offsets[:-1], offsets[1:]) == pytest.approx([ratio(w) for w in every], abs=1e-5)
    found = model.evidence(pa.array(texts + [None, "..."]))
    for text, row in zip(texts, found, strict=False):
        mine = [ratio(w) for w in expressions(text)]
        want = [np.mean(np.log((1 - s) + s * np.exp(mine))) if mine else 0.0 for s in toxicity.SHARES]
        assert row == pytest.approx(want, abs=1e-5)
    assert not found[-2:].any()


def test_every_byte_of_an_expression_counts(spark):
    same = "internationalisation"
    texts = documents(spark, [(k, f"{same}{'filth' if k % 2 else 'peace'} {'Бесконечно' + ('зло' if k % 2 else 'мир')}", "en", "a") for k in range(400)])
    model = toxicity.learn(texts, labels(spark, [(k, 1, k % 2) for k in range(400)]))
    data, offsets = common.buffers(pa.array([same + "filth", same + "peace", "бесконечнозло", "бесконечномир"]))
    found = model.words(data, offsets[:-1], offsets[1:])
    assert found[0] > found[1] + 1 and found[2] > found[3] + 1
    got = {r.doc_id: r.score for r in toxicity.scored(documents(spark, [(1, "БЕСКОНЕЧНОЗЛО", None, None), (2, "бесконечномир", None, None)]), model).collect()}
    assert got[1] > 0.7 > got[2]


def test_windows_are_of_different_expressions(spark):
    docs = documents(spark, [(1, "ab ab AB", None, None), (2, "b", None, None)])
    got = {r.gram.to_bytes(6, "big"): r.n for r in toxicity.windows(docs).collect()}
    pad = b"\x01" * 6
    assert got == {(pad + s)[-6:]: 1 for s in (b"a", b"ab", b"ab\x02", b"b", b"b\x02")}


def test_one_id_with_most_rows_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC", 50)
    monkeypatch.setattr(toxicity, "ORDINARY", 60)
    ids = [k for k in range(400) if crc_fold(k) != 1]
    docs = spark.range(100_000).selectExpr(f"IF(id % 2 = 0, {ids[0]}L, NULL) AS doc_id", "concat('text ', id) AS text")
    docs = docs.unionByName(documents(spark, [(k, f"bad {k}" if k % 2 else f"good {k}", None, None) for k in ids]).select("doc_id", "text"))
    sample = toxicity.labelled(docs, labels(spark, [(k, 1, k % 2) for k in ids] + [(ids[0], 1, 0), (None, 1, 1)])).collect()
    assert len(sample) == 110 and len({r.doc_id for r in sample}) == 110
    assert {(r.toxic, r.apart) for r in sample} == {(0, False), (0, True), (1, False), (1, True)}


def test_toxicity_of_odd_rows(spark):
    docs = odd(spark)
    model = toxicity.learn(docs, labels(spark))
    found = toxicity.scored(docs, model).collect()
    assert len(found) == 10 and {r.score for r in found} == {0.0}
    known = labels(spark, [(k, 1, k % 2) for k in range(2, 80)] + [(3, None, None)])
    texts = documents(spark, [(k, "bad nasty words" if k % 2 else "good kind words", "en", "a") for k in range(2, 80)])
    model = toxicity.learn(texts, known)
    got = {r.doc_id: r.score for r in toxicity.scored(texts, model).collect()}
    assert min(got[k] for k in range(3, 80, 2)) > max(got[k] for k in range(2, 80, 2))
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs, model).collect())
    assert toxicity.scored(empty(spark), model).count() == 0
    assert toxicity.learn(empty(spark), labels(spark)).known == 0
    few = [k for k in range(2, 80) if crc_fold(k) != 1][:4]
    model = toxicity.learn(texts, labels(spark, [(k, 1, int(k == few[0])) for k in few]))  # one toxic text: none to keep apart
    assert {r.score for r in toxicity.scored(texts, model).collect()} == {0.25}


def test_language_on_rows_kept_apart(spark):
    rows = {r.doc_id: r for r in language.op3_language(spark, SF).collect()}
    truth = [d for d in common.read(spark, SF, "documents").collect() if crc_fold(d.doc_id) == 1]
    right = np.mean([rows[d.doc_id].lang_pred == d.lang for d in truth])
    assert right > 0.97 and all(0 <= r.score <= 1 for r in rows.values())
    sure = [d for d in truth if not rows[d.doc_id].rejected]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in sure]) >= right


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    english, french = "the people of this town went to the market in the morning ", "les gens de cette ville vont au marché pendant la matinée "
    train = documents(spark, [(k, (english if k % 2 else french) * 3, "en" if k % 2 else "fr", "a") for k in range(60)] + [(99, "null lang", None, "a")])
    learned = language.learn(train)
    assert set(learned) == {"en", "fr"}
    found = language.predict(docs, learned).collect()
    assert len(found) == 10
    assert sum(r.lang_pred == "und" for r in found) == 4 and all(r.score == 0 for r in found if r.lang_pred == "und")
    got = language.predict(documents(spark, [(1, "the town in the morning", None, None), (2, "cette ville pendant", None, None)]), learned).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "fr"]
    assert language.learn(empty(spark)) == {} and {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
    assert language.predict(empty(spark), learned).count() == 0


def test_language_equals_brute_force(spark):
    """Predictions from the definition: sizes of whole blocks, compressed with each dictionary."""
    import zstandard as zstd

    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    learned = language.learn(docs)
    rows = {r.doc_id: r for r in language.op3_language(spark, "/root/testdata/sf0.001").collect()}

    def size(content, level, part):
        given = zstd.ZstdCompressionParameters.from_level(level, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0)
        digested = zstd.ZstdCompressionDict(b" " * 8 + content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        digested.precompute_compress(compression_params=given)
        return len(zstd.ZstdCompressor(dict_data=digested, compression_params=given).compress(part))

    for d in docs.collect()[:60]:
        letters = "".join(c if c.isalpha() else " " for c in (d.text or "").lower())
        data = f" {' '.join(letters.split())} ".encode()
        assert data == language.folded(d.text or "") or not data.strip()
        levels = language.SHORT_LEVELS if len(data) <= language.SHORT else language.LEVELS
        sizes = {lang: sum(size(c, level, data[k : k + 4096]) for level in levels for k in range(0, len(data), 4096)) for lang, c in learned.items()}
        best, following = sorted(sizes.values())[:2]
        assert rows[d.doc_id].lang_pred == next(lang for lang, n in sizes.items() if n == best)
        assert rows[d.doc_id].score == pytest.approx(1 / sum(2.0 ** -min(n - best, 60) for n in sizes.values()))
        assert rows[d.doc_id].rejected == ((following - best) / best < language.MIN_MARGIN)


def test_more_languages_than_a_group_holds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    stock = {f"l{k}": ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(40)] for k in range(9)}
    rows = [(k, " ".join(rng.choice(stock[f"l{k % 9}"], 30)), f"l{k % 9}", None) for k in range(360)]
    docs = documents(spark, rows)
    want = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language.predict(docs, language.learned(docs)).collect()}
    assert np.mean([want[k][0] == lang for k, _, lang, _ in rows]) > 0.99
    monkeypatch.setattr(language, "GROUP", 2)
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language.predict(docs, language.learned(docs)).collect()}
    assert got == {k: (lang, pytest.approx(s), r) for k, (lang, s, r) in want.items()}


def test_samples_have_a_bound_whatever_rows_an_id_has(spark, monkeypatch):
    monkeypatch.setattr(quality, "POSITIVES", 50)
    monkeypatch.setattr(quality, "UNLABELLED", 70)
    monkeypatch.setattr(language, "TEXTS", 20)
    ids = [k for k in range(400) if crc_fold(k) != 1]
    docs = spark.range(100_000).selectExpr(f"IF(id % 2 = 0, {ids[0]}L, NULL) AS doc_id", "concat('some text ', id) AS text", "'en' AS lang")
    more = documents(spark, [(k, f"un texte {k} avec des mots" if k % 2 else f"a text {k} of words", "fr" if k % 2 else "en", None) for k in ids])
    docs = docs.unionByName(more.select("doc_id", "text", "lang"))
    p, u = quality.sample(docs, labels(spark, [(k, k % 2, 0) for k in ids] + [(ids[0], 1, 0), (None, 1, 0)]))
    assert len(p) == 50 and len(u) == 70
    found = language.learn(docs)
    assert set(found) == {"en", "fr"} and found["fr"].count(b"texte") == 20 and found["en"].count(b" text ") == 20
    only = documents(spark, [(ids[0], "the same text again", "en", None)] * 300)
    assert language.learn(only)["en"] == language.folded("the same text again")


def test_quality_equals_a_plain_computation(spark):
    """The query's scores are those of the network applied to features computed text by text."""
    docs, known = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    rows = {r.doc_id: r for r in quality.op4_quality(spark, SF).collect()}
    model = quality.learn(docs, known)
    w0, b0, w1, b1 = model.w
    for d in docs.collect()[::9]:
        z = np.clip((quality.features(pa.array([d.text]))[0] - model.mean) / model.scale, -8, 8)
        logit = np.tanh(z @ w0 + b0) @ w1 + b1[0]
        assert rows[d.doc_id].score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)
        assert rows[d.doc_id].predicted == (rows[d.doc_id].score >= 0.5)


def test_features_equal_a_plain_computation():
    text = "Hello hello World!! one one two*** 12 | end.\nHello hello again???"
    f = dict(zip(quality.NAMES, quality.features(pa.array([text]))[0], strict=True))
    low = text.lower().split()
    pairs = list(zip(low, low[1:], strict=False))
    size = len(text)
    assert f["log_words"] == pytest.approx(np.log1p(len(low))) and f["word_length"] == pytest.approx(np.mean([len(w) for w in low]))
    assert f["next_same"] == pytest.approx(sum(a == b for a, b in pairs) / len(low)) and f["top_word"] == pytest.approx(max(Counter(low).values()) / len(low))
    assert f["distinct"] == pytest.approx(len(set(low)) / len(low) ** 0.85) and f["distinct_pairs"] == pytest.approx(len(set(pairs)) / len(pairs))
    assert f["capitals"] == pytest.approx(sum(c.isupper() for c in text) / size) and f["digits"] == pytest.approx(2 / size) and f["bars"] == pytest.approx(1 / size)


def test_long_texts_count_in_whole():
    learned = {"en": b" the people of this town went to the market" * 20, "fr": b" les gens de cette ville vont au march" * 20}
    usual = language.Compressors(learned, language.LEVELS)
    text = language.folded("the people of this town " * 200 + "cette ville vont au marché les gens " * 600)
    assert language.identify(text, ["en", "fr"], usual, usual)[0] == "fr"


def test_quality_on_rows_kept_apart(spark):
    rows = {r.doc_id: r for r in quality.op4_quality(spark, "/root/testdata/sf0.1").collect()}
    truth = [t for t in common.read(spark, "/root/testdata/sf0.1", "labels").collect() if crc_fold(t.doc_id) == 1]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert np.mean([rows[t.doc_id].predicted == t.quality for t in truth]) > 0.97
    assert np.mean([rows[t.doc_id].predicted for t in truth if t.quality]) > 0.98


def test_the_prior_is_near_the_share_of_positives():
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (1500, len(quality.NAMES)))
    u = np.vstack([rng.normal(0, 1, (1050, len(quality.NAMES))), rng.normal(3, 1, (450, len(quality.NAMES)))])
    assert quality.estimate_prior(p, u) == pytest.approx(0.7, abs=0.06)
    net = quality._train(p, u, 0.7, 20, 7)
    assert net.score(p).mean() > 0.8 and net.score(u[1050:]).mean() < 0.2


def test_quality_features():
    f = quality.features(pa.array(["a a a a", None, "", "Word*** next$$$", "one two. three\nfour"]))
    at = {n: k for k, n in enumerate(quality.NAMES)}
    assert f[:, at["empty"]].tolist() == [0, 1, 1, 0, 0]
    assert f[0, at["next_same"]] == 0.75 and f[0, at["top_word"]] == 1 and f[3, at["symbols"]] == pytest.approx(6 / 15)
    assert np.isfinite(f).all() and np.array_equal(f[1], f[2])


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    got = quality.score(docs, None, ["doc_id", "size"]).collect()
    assert len(got) == 10 and {(r.score, r.predicted, r.size) for r in got} == {(0.5, 1, 1)}
    assert quality.learn(docs, labels(spark)) is None and quality.learn(empty(spark), labels(spark, [(1, 1, 0)])) is None
    model = quality.learn(docs, labels(spark, [(k, 1, 0) for k in range(9)] + [(None, 1, 0), (3, None, None)]))
    got = quality.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty(spark), model, ["doc_id"]).count() == 0
    assert quality.keep_good(docs, labels(spark)).columns == docs.columns and quality.keep_good(docs, labels(spark)).count() == 10
