"""The toxicity model counts over all labelled texts."""

import numpy as np

from tracewright.llm import toxicity


def test_fit_sees_all_labelled_texts(spark):
    # 2,500 toxic texts and a long one; those of the last ids alone have the words that tell
    rng = np.random.default_rng(4)
    word = lambda k: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, k))
    usual = [word(7) for _ in range(300)]
    text = lambda extra: " ".join([*rng.choice(usual, 12), *extra])
    rows = [(i, text(["vexilloid"] if i % 125 == 0 else ["grumbling"]), 1) for i in range(2500)] + [(10_000 + i, text([]), 0) for i in range(2500)]
    rows += [(20_000 + i, " ".join(rng.choice(usual, 4000)) + f" quagmire{'s' * i}", 1) for i in range(2)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, toxic int")
    learned = toxicity._labelled(docs, labels, toxicity.F.lit(True), "doc_id", "text")
    counts = toxicity._counted(learned)
    names = toxicity.features([b"vexilloid", b"quagm"])[1].view(np.int64)
    got = {r.feature: r.c1 + r.c3 for r in counts.where(counts.feature.isin([int(n) for n in names])).collect()}
    assert learned.count() == 5002 and got[int(names[0])] == 20 and 2 in got.values()
    assert toxicity._frequent_words(learned)["vexilloid"] == 20
    restorer, scorer = toxicity.fit(docs, labels)
    bad, good = scorer([text(["vexilloid"]).encode(), text(["grumbling"]).encode()]), scorer([text([]).encode() for _ in range(50)])
    assert (bad >= toxicity.THRESHOLD).all() and (good < toxicity.THRESHOLD).all()


def test_only_texts_that_may_be_labelled_are_shuffled(spark):
    # copies share the greatest label of their rows; of 20,000 texts without a label few pass the filter
    F = toxicity.F
    docs = spark.range(20_600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 600, F.col("id") % 300).otherwise(F.col("id"))).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("toxic"))
    got = {r.text: r.toxic for r in toxicity._labelled(docs, labels, F.lit(True), "doc_id", "text").collect()}
    assert got == {f"text {i}": int(any(j % 7 == 0 for j in (i, i + 300) if j < 400)) for i in range(300)}
    wanted = toxicity.written(docs.where("doc_id < 300").select("text"), "wanted")
    kept = {r.text for r in toxicity._maybe_in(docs.select("text"), wanted, "text").distinct().collect()}
    assert set(got) <= kept and len(kept) < 300 + 20_000 // 8
