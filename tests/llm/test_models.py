import zlib

import numpy as np
import pytest

from sluice.llm import langid, quality, textmodel
from sluice.llm.bytecnn import ByteConvNet

SF = "/root/testdata/sf0.01"


def test_windows_cover_the_whole_text():
    net = ByteConvNet(2)
    for n in (0, 1, 511, 512, 513, 991, 992, 993, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        w = net.windows(data)
        assert w.shape[1] == net.window
        seen = np.zeros(n, bool)
        for k, row in enumerate(w):
            part = data[k * net.step : k * net.step + net.window]
            assert bytes(row[: len(part)]) == part
            seen[k * net.step : k * net.step + net.window] = True
        assert seen.all()


def test_tables_agree_with_the_kernels():
    net = ByteConvNet(3)
    x = np.random.default_rng(0).integers(0, 256, (5, net.window)).astype(np.uint8)
    assert np.allclose(net.pool(x), net._pool_train(x)[0], atol=1e-4)


def test_filters_start_at_every_byte():
    net = ByteConvNet(2, widths=(3, 4, 6))
    x = np.random.default_rng(1).integers(1, 256, (2, net.window)).astype(np.uint8)
    n = net.window - 6 + 1
    want = np.concatenate([np.max([sum(k[j][x[:, i + j]] for j in range(len(k))) for i in range(n)], 0) for k in net.kernels], 1) + net.bias
    assert np.allclose(net.pool(x), want, atol=1e-4) and np.allclose(net._pool_train(x)[0], want, atol=1e-4)


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (200, 512)).astype(np.uint8)
    y = np.arange(200) % 2
    x[y == 1, 100:104] = np.frombuffer(b"!!??", np.uint8)
    net = ByteConvNet(2)
    net.fit(x, y, np.ones(200), steps=150)
    assert (net.logits(net.pool(x)).argmax(1) == y).mean() > 0.97


def test_batches_do_not_change_results():
    net = ByteConvNet(2)
    texts = [b"", b"short", b"long " * 5000, b"x" * 511]
    together = textmodel.class_logs(net, texts)
    alone = np.concatenate([textmodel.class_logs(net, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_rows(spark, docs):
    out = langid.identify(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(out) == len(truth)
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_more_labels_than_full_classes(spark):
    # 70 languages, each with words of its own
    rng = np.random.default_rng(2)
    words = [["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(6)] for _ in range(70)]
    rows = [(k, " ".join(rng.choice(words[k % 70], 60)), f"l{k % 70:02d}") for k in range(70 * 16)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out} == {r[2] for r in rows}
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in out if r["held_out"]]) > 0.9


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_sample_is_bounded(spark, docs, monkeypatch):
    """Very many rows of one id and very long texts: no more windows than the bound come to the driver, all texts count."""
    seen = []
    fit = ByteConvNet.fit
    monkeypatch.setattr(ByteConvNet, "fit", lambda self, x, y, weight, **k: (seen.append((x.shape, weight.sum())), fit(self, x, y, weight, **k))[1])
    hot = [(4, "le chat est là " * 300, "fr")] * 50 + [(5, "the cat is there " * 3000, "en")]
    df = spark.createDataFrame(hot, "doc_id long, text string, lang string")
    textmodel.fit(df.withColumnRenamed("lang", "label"), "label", ["en", "fr"], 5, most_windows=40)
    textmodel.fit(df.withColumnRenamed("lang", "label"), "label", ["en", "fr"], 5)
    net = ByteConvNet(2)
    assert seen[0][0] == (40, net.window)
    assert seen[1][0][0] == sum(len(net.windows(t.encode())) for _, t, _ in hot)
    assert seen[1][1] == pytest.approx(2)


def test_odd_rows_of_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, steps=60)
    assert model[1] is not None
    good = docs.join(labels.where("quality = 1"), "doc_id").first()["text"]
    rows = [(1, None), (2, ""), (None, good), (3, good * 300), (3, good * 300), (4, "\n")]
    out = quality.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    scores = [(r["doc_id"], round(r["score"], 9)) for r in out]
    assert len(scores) == 6 and all(0 <= s <= 1 for _, s in scores)
    by = dict(scores)
    assert by[1] == by[2] and scores.count((3, by[3])) == 2


def test_odd_rows(spark, docs):
    odd = spark.createDataFrame([(900001, None, "en", "z"), (900002, "", None, "z"), (None, "1234 !!", None, "z"), (900003, "abc " * 20000, None, "z"), (900003, "abc " * 20000, None, "z")], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, steps=60)
    out = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert {(900001, "und", 0.0), (900002, "und", 0.0), (None, "und", 0.0)} <= out and len(out) == 4
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (None, 1, "z"), (2, None, "q")], "doc_id long, quality int, text string")
    scores = quality.classify(odd.withColumnRenamed("score", "predicted"), labels).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.classify(odd.limit(0), labels.limit(0)).count() == 0
