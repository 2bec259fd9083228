"""Sinks, the streaming job and the learned classifier."""

import pytest

from pyspark.sql import functions as F

from tallyspark.operators import learn, sinks, stores, summary
from tallyspark.operators.classify import classify
from tallyspark.operators.standardise import standardise
from tallyspark.streaming import ingest

CSV = "Date,Description,Debit,Credit,Balance\n01 Jan 2026,KFC AJAH,100.00,,900.00\n" \
      "02 Jan 2026,SALARY,,500.00,1400.00\n"


def test_append_skips_known_fingerprints(spark, entries, tmp_path):
    store = str(tmp_path / "tx")
    rows = [("2026-01-01", "KFC", 1, "debit", None), ("2026-02-01", "UBER", 2, "debit", None)]
    first = classify(standardise(entries(rows)))
    sinks.append_transactions(first, store, exists=False)
    again = classify(standardise(entries([*rows, ("2026-02-03", "SPAR", 3, "debit", None)])))
    sinks.append_transactions(again, store)
    stored = spark.read.parquet(store)
    assert sorted(r.description for r in stored.collect()) == ["KFC", "SPAR", "UBER"]
    assert "2026-02" in {str(r.month) for r in stored.collect()}
    batch = sinks.materialise(again.where("tx_date >= '2026-02-01'"), "test")
    known = sinks.same_months(sinks.stored_months(batch, store), batch)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "month" in plan.split("PartitionFilters")[1]
    assert known.count() == 2


def test_append_computes_its_batch_once(spark, entries, tmp_path):
    """However often the batch is read, its rows are made once; nothing temporary stays."""
    store, made = str(tmp_path / "tx"), spark.sparkContext.accumulator(0)
    first = classify(standardise(entries([("2026-01-01", "KFC", 1, "debit", None)])))
    sinks.append_transactions(first, store, exists=False)
    schema = first.schema

    def counted(row):
        made.add(1)
        return row
    rows = classify(standardise(entries([("2026-01-01", "KFC", 1, "debit", None),
                                         ("2026-03-01", "SPAR", 2, "debit", None)])))
    again = spark.createDataFrame(rows.rdd.map(counted), schema)
    sinks.append_transactions(again, store)
    assert made.value == 2
    assert sorted(r.month for r in spark.read.parquet(store).collect()) == ["2026-01", "2026-03"]
    root = spark.conf.get("spark.checkpoint.dir")
    assert sinks.paths_like(spark, f"{root}/tallyspark/append-*") == []


def files_of(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_write_touches_its_buckets_only(spark, tmp_path):
    path, names = str(tmp_path / "s"), "user_id string, month int, v int"
    rows = [(f"u{k}", m, 0) for k in range(40) for m in (1, 2)]
    stores.upsert(spark.createDataFrame(rows, names), path, ["user_id", "month"], buckets=8)
    before = files_of(tmp_path / "s" / "rows")
    stores.upsert(spark.createDataFrame([("u3", 2, 9), ("new", 1, 5)], names), path,
                  ["user_id", "month"])
    want = {(u, m): v for u, m, v in rows} | {("u3", 2): 9, ("new", 1): 5}
    assert {(r.user_id, r.month): r.v for r in stores.read_store(spark, path).collect()} == want
    after = files_of(tmp_path / "s" / "rows")
    assert before.items() <= after.items()
    places = stores.manifest(spark, path).places
    assert set(places.values()) == {0, 1} and 1 <= sum(v == 1 for v in places.values()) <= 2
    users = spark.createDataFrame([("u5",), ("u6",)], "user_id string")
    stores.replace(spark.createDataFrame([("u5", 7, 7)], names), path, users)
    left = stores.read_store(spark, path)
    assert [tuple(r) for r in left.where("user_id in ('u5', 'u6')").collect()] == [("u5", 7, 7)]
    assert left.count() == len(want) - 3
    assert stores.read_store(spark, path, 0).count() == 80
    stores.expire(spark, path, keep=1)
    assert stores.versions(spark, path) == [2] and stores.read_store(spark, path).count() == 78


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path, names = str(tmp_path / "s"), "user_id string, v int"
    good = spark.createDataFrame([("a", 1), ("b", 1)], names)
    stores.upsert(good, path, ["user_id"], buckets=2)
    bad = good.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        stores.upsert(bad, path, ["user_id"])
    with pytest.raises(Exception, match="lost"):
        stores.merge(good, path, lambda old, new: old.unionByName(
            new.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))))
    assert stores.versions(spark, path) == [0]
    assert sorted(map(tuple, stores.read_store(spark, path).collect())) == [("a", 1), ("b", 1)]
    stores.upsert(good.withColumn("v", F.lit(2)), path, ["user_id"])
    assert {r.v for r in stores.read_store(spark, path).collect()} == {2}
    stores.upsert(good.limit(0), path, ["user_id"])
    assert stores.read_store(spark, path).count() == 2
    empty = str(tmp_path / "empty")
    stores.upsert(good.limit(0), empty, ["user_id"])
    assert stores.read_store(spark, empty).count() == 0
    with pytest.raises(FileNotFoundError):
        stores.read_store(spark, str(tmp_path / "none"))


def test_merged_months_equal_the_whole_history(spark, entries, tmp_path):
    path = str(tmp_path / "state")
    rows = [(f"2026-{1 + k % 5:02d}-{1 + k % 27:02d}", text, k, kind, None) for k, (text, kind)
            in enumerate([("KFC AJAH", "debit"), ("SALARY", "credit"), ("UBER", "debit")] * 20)]
    tx = classify(standardise(entries(rows)))
    for batch, part in enumerate((tx.where("row_ord % 2 = 0"), tx.where("row_ord % 2 = 1"))):
        stores.add_to_state(part, path, batch=batch)
        stores.add_to_state(part, path, batch=batch)  # a batch that is run again
    state = stores.read_store(spark, path)
    for ours, whole in ((stores.monthly_summary, summary.monthly_summary),
                        (stores.category_spend, summary.category_spend),
                        (stores.period_summary, summary.period_summary)):
        a, b = ours(state), whole(tx)
        assert a.dtypes == b.dtypes
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rewrites_leave_the_old_version(spark, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "user_id string, v int")
    sinks.write_upsert(spark, None, old, rows, ["user_id"])
    sinks.write_upsert(spark, old, new,
                       spark.createDataFrame([("b", 2)], "user_id string, v int"), ["user_id"])
    assert sorted(map(tuple, spark.read.parquet(new).collect())) == [("a", 1), ("b", 2)]
    assert spark.read.parquet(old).count() == 2


def test_new_files_are_processed_once(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    status, progress = str(tmp_path / "status"), str(tmp_path / "progress")
    state = str(tmp_path / "state")
    (folder / "u1").mkdir(parents=True)

    def run():
        ingest.run_files(ingest.file_stream(spark, str(folder)), store, status, progress, state)
        return spark.read.parquet(store)

    (folder / "u1" / "jan.csv").write_text(CSV)
    (folder / "u1" / "bad.pdf").write_bytes(b"%PDF")
    assert run().count() == 2
    (folder / "u1" / "again.csv").write_text(CSV + "03 Jan 2026,UBER TRIP,50.00,,1350.00\n")
    stored = run()
    assert sorted(r.description for r in stored.collect()) == ["KFC AJAH", "SALARY", "UBER TRIP"]
    totals = stores.period_summary(stores.read_store(spark, state)).first()
    assert (totals.tx_count, totals.total_income, totals.total_expenses) == (3, 500, 150)
    states = {r.filename: (r.status, r.error_message)
              for r in spark.read.parquet(status).collect()}
    assert states == {"jan.csv": ("complete", None), "again.csv": ("complete", None),
                      "bad.pdf": ("failed", "Unsupported file type: pdf")}


def test_learned_labels_and_fallback(spark, tmp_path):
    samples = spark.createDataFrame(
        [(i, text, label) for i, (text, label) in enumerate(
            [("pizza dinner place", "food"), ("taxi ride home", "transport")] * 10)],
        "sample_id long, description string, label string")
    model = learn.fit_classifier(samples)
    tx = spark.createDataFrame([("pizza dinner", "debit"), ("HOUSE RENT", "debit")],
                               "description string, tx_type string")
    got = {r.description: r for r in learn.score_classifier(tx, model).collect()}
    assert (got["pizza dinner"].category, got["pizza dinner"].classified_by) == ("food", "ml")
    assert (got["HOUSE RENT"].category, got["HOUSE RENT"].classified_by,
            got["HOUSE RENT"].confidence) == ("rent", "rule", 0.95)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    assert learn.PipelineModel.load(path).transform(tx).count() == 2


def test_macro_f1(spark):
    predictions = spark.createDataFrame(
        [(0, "a", "a"), (0, "a", "b"), (0, "b", "b"), (1, "a", "a"), (1, "b", "c")],
        "fold int, label string, prediction string")
    per_fold = {r.fold: r.f1_macro for r in learn.fold_f1(predictions).collect()}
    assert per_fold[0] == pytest.approx((2 / 3 + 2 / 3) / 2)
    assert per_fold[1] == pytest.approx((1 + 0 + 0) / 3)


def test_repeated_samples_fit_like_one_row_each(spark):
    """Weighted distinct rows have the optimum of the rows they stand for."""
    rows = [("fuel station lekki", "transport"), ("bus ticket fare", "transport"),
            ("fuel bus pass", "transport"), ("rice market bread", "food"),
            ("bread bakery market", "food"), ("fuel for bakery oven", "food")]
    times = [4, 1, 3, 2, 5, 1]
    repeated = [r for r, n in zip(rows, times) for _ in range(n)]
    names = "description string, label string"
    once = learn._tokenised(spark.createDataFrame(repeated, names))
    single = once.select("label", "_terms", F.lit(1).alias("n"))
    a, b = learn._fit_terms(learn.distinct_samples(once)), learn._fit_terms(single)
    assert a[0].vocabulary == b[0].vocabulary and a[1].getScalingVec() == b[1].getScalingVec()
    assert abs(a[3].coefficientMatrix.toArray() - b[3].coefficientMatrix.toArray()).max() < 1e-3
    from collections import Counter
    terms = [r._terms for r in once.collect()]
    uses = Counter(t for ts in terms for t in ts)
    held = Counter(t for ts in terms for t in set(ts))
    want = sorted((t for t in uses if held[t] >= 2), key=lambda t: (-uses[t], t))
    assert [(r.term, r.samples) for r in learn.vocabulary(learn.distinct_samples(once))] == [
        (t, held[t]) for t in want]


def test_a_fit_reaches_the_optimum_in_few_passes(spark, monkeypatch):
    """The slope of the loss, taken from whole rows, is nearly zero at the fitted model."""
    import math
    import random
    import numpy as np
    from tallyspark.operators import softmax
    draw, passes = random.Random(3), []
    words = ["".join(draw.choices("abcdefgh", k=3)) for _ in range(300)]
    rows = [(k, " ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(300)], k=40))
             + f" {label * 2}", label) for k in range(300) for label in draw.choices("xyyyz")]
    rows += [(900, "7 !", "x"), (901, "", "z"), (902, words[0], None)] + [(903 + k, "none none", None) for k in range(2)]
    summed = softmax._summed
    monkeypatch.setattr(softmax, "SLICE_BYTES", 2000)
    monkeypatch.setattr(softmax, "_summed", lambda *a: passes.append(1) or summed(*a))
    samples = spark.createDataFrame(rows, "sample_id int, description string, label string")
    model = learn.fit_classifier(samples)
    assert 2 < len(passes) < 60 and "none" not in model.stages[3].vocabulary
    counter, unit, fitted = model.stages[3], model.stages[5], model.stages[6]
    named = [r for r in rows if r[2]]
    assert model.stages[7].getLabels() == ["x", "y", "z"] and unit.getP() == 2
    x = np.zeros((len(named), len(counter.vocabulary)))
    place = {t: k for k, t in enumerate(counter.vocabulary)}
    for row, (_, text, _) in zip(x, named):
        w = [v for v in text.split() if v.isalpha()]
        for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            if t in place:
                row[place[t]] += 1
    x *= [math.log((1 + len(named)) / (1 + n)) + 1 for t, n in zip(
        counter.vocabulary, (x > 0).sum(axis=0))]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    y = np.array(["xyz".index(r[2]) for r in named])
    one = np.eye(3)[y]
    # The unlabelled samples count for a label of its own in the balance, as it ever did.
    weight = (len(rows) / (4 * one.sum(axis=0)))[y]
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    margins = x @ w.T + b
    shares = np.exp(margins - margins.max(axis=1, keepdims=True))
    rest = (shares / shares.sum(axis=1, keepdims=True) - one) * weight[:, None] / weight.sum()
    slope = rest.T @ x + w / len(named)
    assert abs(slope).max() < 1e-4 and abs(rest.sum(axis=0)).max() < 1e-4
    assert model.transform(samples).count() == len(rows)


def test_folds_count_terms_together(spark):
    """Terms of the parts a model sees are what they are when counted alone."""
    texts = spark.createDataFrame(
        [("a", "one two two three", 2, 0), ("b", "two two", 1, 1), ("a", "", 3, 1),
         ("b", "one two", 4, 2), (None, "four one two", 1, 2)],
        "label string, _text string, n long, _part int")
    counts = learn._counted(texts, 3)
    assert {r.term: (r.uses_0, r.samples_0, r.uses_1, r.samples_1, r.uses_2, r.samples_2)
            for r in counts.collect()} == {
        "one": (2, 2, 0, 0, 5, 5), "two": (4, 2, 2, 1, 5, 5), "three": (2, 2, 0, 0, 0, 0),
        "one two": (2, 2, 0, 0, 5, 5), "two two": (2, 2, 1, 1, 0, 0),
        "two three": (2, 2, 0, 0, 0, 0), "four": (0, 0, 0, 0, 1, 1),
        "four one": (0, 0, 0, 0, 1, 1)}
    assert [(r.term, r.samples) for r in learn._most_used(counts, [0, 1])] == [
        ("two", 3), ("two two", 3), ("one", 2), ("one two", 2), ("three", 2), ("two three", 2)]


def test_rules_read_unsure_texts_alone(spark):
    samples = spark.createDataFrame([("zebra", "food"), ("lion", "rent")] * 20,
                                    "description string, label string")
    model = learn.fit_classifier(samples)
    tx = spark.createDataFrame([("zebra", "debit"), ("HOUSE RENT", "debit")],
                               "description string, tx_type string")
    scored = learn.score_classifier(tx, model)
    assert {tuple(r)[:3] for r in scored.select("description", "category", "classified_by")
            .collect()} == {("zebra", "food", "ml"), ("HOUSE RENT", "rent", "rule")}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "(probability" in plan and "THEN description" in plan


def test_folds_are_stratified(spark):
    samples = spark.createDataFrame(
        [(k, "many" if k % 9 else "few") for k in range(100)] + [(None, "one"), (7, None)],
        "sample_id int, label string")
    counts = {}
    rows = learn.stratified_folds(samples).collect()
    assert len(rows) == 102
    for r in rows:
        counts.setdefault(r.label, [0] * 5)[r.fold] += 1
    assert all(max(c) - min(c) <= 1 for c in counts.values())
    assert sum(counts["few"]) == 12 and min(counts["few"]) == 2
    assert learn.stratified_folds(samples.limit(0)).count() == 0


def test_training_report_counts_stored_predictions(spark):
    words = {"food": ["rice market", "bread bakery", "market bread", "lunch rice"],
             "transport": ["fuel station", "bus fare", "bus station", "fuel fare"]}
    rows = [(f"{k}{label}", words[label][k % 4], label) for label in words for k in range(20)]
    samples = spark.createDataFrame(rows, "sample_id string, description string, label string")
    predictions = learn.out_of_fold(samples)
    found = predictions.collect()
    assert sum(r.n for r in found) == 40 and {r.fold for r in found} == set(range(5))
    scores = []
    for fold in range(5):
        part, f1 = [r for r in found if r.fold == fold], []
        for label in sorted({r.label for r in part} | {r.prediction for r in part}):
            tp = sum(r.n for r in part if r.label == r.prediction == label)
            wrong = sum(r.n for r in part if r.label != r.prediction
                        and label in (r.label, r.prediction))
            f1.append(2 * tp / (2 * tp + wrong))
        scores.append(sum(f1) / len(f1))
    report = learn.macro_f1(predictions).first()
    assert report.cv_f1_macro_mean == round(sum(scores) / 5, 4) == 1.0


def test_saved_model_is_used_if_there(spark, tmp_path):
    from tallyspark.operators import pipeline
    assert pipeline.load_classifier(spark, str(tmp_path / "none")) is None
    files = spark.createDataFrame([("u", "s", "s.csv", "csv", 1, "Date,Details,Debit,Credit,"
                                    "Balance\n1/2/2024,zebra,10.00,,90.00\n", "pending", None)],
                                  "user_id string, upload_id string, filename string, file_type "
                                  "string, file_size_kb int, text string, status string, "
                                  "error_message string")
    rules = pipeline.run_pipeline(files, model_path=str(tmp_path / "none")).transactions
    assert [r.classified_by for r in rules.collect()] == ["rule"]
    samples = spark.createDataFrame([("zebra", "food"), ("zebra", "food"), ("lion", "rent"),
                                     ("lion", "rent")] * 20, "description string, label string")
    learn.fit_classifier(samples).save(str(tmp_path / "model"))
    learned = pipeline.run_pipeline(files, model_path=str(tmp_path / "model")).transactions
    assert [(r.category, r.classified_by) for r in learned.collect()] == [("food", "ml")]
