"""Queries over stored tables: write rules, reports, documents, search, assistant."""

from pyspark.sql import functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.operators import (assistant, clean, forecast, ledger, recommend, recurring, search,
                                  stores, summary)
from tallyspark.operators.health import health_dimensions, health_score, score_users
from tallyspark.operators.features import user_features
from tallyspark.operators.learn import macro_f1
from tallyspark.operators.sinks import materialise, shared_folder
from tallyspark.plans import duck, frames
from tallyspark.plans import queries_health as H
from tallyspark.plans import queries_recommend as R
from tallyspark.plans.queries_cleaning import COLUMNS, DUP, EXACT, FILL, NEAR
from tallyspark.plans.queries_summary import CATEGORIES, MONTHS, PERIOD, SPEND
from tallyspark.plans.registry import plain, register
from tallyspark.plans.tables import derive, derive_sql, table
from tallyspark.schema import STANDARD

_WIDTHS = {c: f"substr({c}, 1, {n}) as {c}" for c, n in V.STORED_WIDTHS.items()}
_STORED = ", ".join(_WIDTHS.get(c, c) for c in [
    "user_id", "upload_id", "row_ord", "tx_date", "description", "raw_desc", "tx_type", "channel",
    "merchant", "bank", "fingerprint"])


@register("append_new_tx", duck.query(f"""
    select {_STORED}, cast(amount as double) as amount, cast(balance as double) as balance
    from ({EXACT.format('dup_std')}) i
    where not exists (select 1 from std s where s.tx_date < date '1999-01-01'
                      and s.user_id = i.user_id and s.fingerprint = i.fingerprint)""",
    "std", **DUP))
def append_new_tx(spark, sf_dir):
    stored = frames.standard(spark, sf_dir).where("tx_date < date'1999-01-01'")
    return plain(ledger.new_transactions(frames.repeated(spark, sf_dir), stored))


UPLOADS = """
    select user_id, upload_id, min(tx_date) as period_start, max(tx_date) as period_end,
           count(*) as tx_count from {0} group by user_id, upload_id"""


def _uploads(tx):
    return tx.groupBy("user_id", "upload_id").agg(
        F.min("tx_date").alias("period_start"), F.max("tx_date").alias("period_end"),
        F.count(F.lit(1)).alias("tx_count"))


@register("upsert_uploads", duck.query("""
    select user_id, upload_id, period_start, period_end, tx_count, 'complete' as status
    from uploads where period_end >= date '2001-06-01'
    union all
    select user_id, upload_id, period_start, period_end, 0, 'pending'
    from uploads where period_end < date '2001-06-01'""",
    "std", uploads=UPLOADS.format("std")))
def upsert_uploads(spark, sf_dir):
    uploads = _uploads(frames.standard(spark, sf_dir))
    stored = (uploads.withColumn("tx_count", F.lit(0).cast("bigint"))
              .withColumn("status", F.lit("pending")))
    done = (uploads.where("period_end >= date'2001-06-01'")
            .withColumn("status", F.lit("complete")))
    return ledger.upsert(stored, done, ["user_id", "upload_id"])


SNAPSHOTS = """
    select m.user_id, m.month, m.total_income, m.total_expenses, m.net_savings,
           case when m.total_income > 0 then round(m.net_savings / m.total_income, 4)
                else 0 end as savings_rate,
           s.score as health_score, c.spend as expense_by_category
    from months m
    left join scored s on m.user_id = s.user_id
    left join (select user_id, month,
                      concat('{', string_agg(concat('"', slug, '":', total), ','
                                             order by slug), '}') as spend
               from (select user_id, cast(date_trunc('month', tx_date) as date) as month,
                            category as slug, sum(amount) as total
                     from lab where tx_type = 'debit' group by 1, 2, 3)
               group by user_id, month) c
      on m.user_id = c.user_id and m.month = c.month"""
SNAPSHOT_PARTS = {**H._parts("lab"), "scored": H.SCORED, "months": MONTHS.format("lab"),
                  "snapshots": SNAPSHOTS}
_SNAPSHOT_COLUMNS = ["user_id", "month", "total_income", "total_expenses", "net_savings",
                     "savings_rate", "health_score", "expense_by_category"]


def snapshots(spark, sf_dir):
    # Months, spend and features read the labelled rows; they are labelled once.
    tx = materialise(frames.labelled(spark, sf_dir), "labelled")
    scored = health_score(health_dimensions(user_features(tx), frames.profiles(spark, sf_dir)))
    return ledger.stored_snapshot(summary.monthly_summary(tx), scored,
                                  summary.category_spend(tx))


@register("upsert_snapshots", duck.query("""
    select user_id, month, total_income, total_expenses, net_savings, savings_rate,
           case when month >= date '2001-01-01' then health_score else 0 end as health_score,
           case when month >= date '2001-01-01' then expense_by_category else '{}' end
               as expense_by_category
    from snapshots""", "lab", **SNAPSHOT_PARTS))
def upsert_snapshots(spark, sf_dir):
    """Older snapshots without scores; those of 2001 are written again with scores."""
    fresh = materialise(snapshots(spark, sf_dir).select(*_SNAPSHOT_COLUMNS), "snapshots")
    stored = (fresh.withColumn("health_score", F.lit(0))
              .withColumn("expense_by_category", F.lit("{}")))
    return plain(ledger.upsert(stored, fresh.where("month >= date'2001-01-01'"),
                               ["user_id", "month"]))


@register("upsert_versions", duck.query(f"""
    select user_id, month, case when month < date '1996-01-01' then 0 else total_expenses end
               as total_expenses, tx_count
    from ({MONTHS.format("lab")})""", "lab"))
def upsert_versions(spark, sf_dir):
    """Months are stored without expenses; those since 1996 are upserted with them, by user
    buckets, and the newest version is read."""
    months = materialise(summary.monthly_summary(frames.normal(spark, sf_dir))
                         .select("user_id", "month", "total_expenses", "tx_count"), "months")
    path = shared_folder(spark, "months-store")
    stores.upsert(months.withColumn("total_expenses", F.lit(0).cast("decimal(18,2)")), path,
                  ["user_id", "month"])
    stores.upsert(months.where("month >= date'1996-01-01'"), path, ["user_id", "month"])
    return plain(stores.read_store(spark, path))


def _state(spark, sf_dir):
    """Monthly totals after three batches, each with rows of all months."""
    tx = materialise(frames.labelled(spark, sf_dir).select(
        "user_id", "tx_date", "category", "tx_type", "amount", "row_ord"), "labelled")
    path = shared_folder(spark, "month-state")
    for batch in range(3):
        stores.add_to_state(tx.where(F.col("row_ord") % 3 == batch), path, batch=batch)
    return stores.read_store(spark, path)


@register("merged_months", duck.query(MONTHS.format("lab"), "lab"))
def merged_months(spark, sf_dir):
    """The monthly summary from running totals."""
    return plain(stores.monthly_summary(_state(spark, sf_dir)))


@register("merged_spend", duck.query(SPEND.format("lab"), "lab", categories=CATEGORIES))
def merged_spend(spark, sf_dir):
    """Spend by month and category from running totals."""
    return plain(stores.category_spend(_state(spark, sf_dir)))


@register("merged_periods", duck.query(PERIOD.format("lab"), "lab"))
def merged_periods(spark, sf_dir):
    """The summary of each user's whole period from running totals."""
    return plain(stores.period_summary(_state(spark, sf_dir)))


@register("latest_snapshot", duck.query("""
    select * exclude (rn) from (select *, row_number() over (
        partition by user_id order by month desc) as rn from snapshots) where rn = 1""",
    "lab", **SNAPSHOT_PARTS))
def latest_snapshot(spark, sf_dir):
    return plain(ledger.latest_snapshot(snapshots(spark, sf_dir).select(*_SNAPSHOT_COLUMNS)))


def _recs(name: str, checks: list[str]) -> dict[str, str]:
    return {f"found_{name}": R.found_sql(checks),
            f"recs_{name}": R.recs_sql(checks, f"found_{name}")}


_REC = "user_id, cast(rank as int) as rank, type, title, priority"


@register("replace_recs", duck.query(f"""
    select {_REC} from recs_stored
    where user_id not in (select user_id from recs_fresh where type = 'alert')
    union all select {_REC} from recs_fresh where type = 'alert'""",
    "rec", **R.PARTS, **_recs("stored", ["spending"]), **_recs("fresh", ["savings"])))
def replace_recs(spark, sf_dir):
    """Users with a cash-flow alert get that alert in place of their stored advice."""
    planned = materialise(R.planned(spark, sf_dir), "planned")
    columns = ["user_id", "rank", "type", "title", "priority"]
    stored = recommend.recommend(planned, ["spending"]).select(*columns)
    fresh = (recommend.recommend(planned, ["savings"]).where("type = 'alert'")
             .select(*columns))
    return ledger.replace_for_users(stored, fresh, fresh.select("user_id"))


@register("active_recs", duck.query(f"""
    select {_REC}, expires_at from (
        select *, priority = 8 as is_dismissed,
               last_date + cast(priority * 30 as int) as expires_at
        from recs_all r join (select user_id as u, last_date from features) f on r.user_id = f.u)
    where not is_dismissed and expires_at > date '2001-10-15'""",
    "rec", **R.PARTS, **_recs("all", recommend.ALL_CHECKS)))
def active_recs(spark, sf_dir):
    planned = materialise(R.planned(spark, sf_dir), "planned")
    stored = (recommend.recommend(planned).join(planned.select("user_id", "last_date"),
                                                "user_id")
              .withColumn("is_dismissed", F.col("priority") == 8)
              .withColumn("expires_at", F.expr("date_add(last_date, priority * 30)")))
    active = ledger.active_recommendations(stored, F.lit("2001-10-15").cast("date"))
    return active.select("user_id", "rank", "type", "title", "priority", "expires_at")


#: Every event is a change to the manual entry of its user and day.
CHANGE = {
    "user_id": "cast(user_id as string)", "seq": "event_id",
    "entry_id": "concat(cast(user_id as string), '-', cast(cast(ts as date) as string))",
    "op": "case event_type when 'error' then 'delete' when 'signup' then 'add' "
          "else 'update' end",
    "tx_date": "cast(ts as date)", "description": "event_type", "amount": "value",
    "tx_type": "case when event_type = 'signup' then 'credit' else 'debit' end",
    "category": "case when event_type = 'view' then null else event_type end",
    "channel": "case when event_type = 'click' then '' else 'mobile' end",
    "notes": "case when event_type = 'purchase' then props end",
}


@register("manual_ledger", duck.query("""
    select c.user_id, c.entry_id, a.added_seq, tx_date, description, amount, tx_type,
           coalesce(nullif(category, ''), 'miscellaneous') as category,
           coalesce(nullif(channel, ''), 'cash') as channel, coalesce(notes, '') as notes
    from (select *, row_number() over (partition by user_id, entry_id order by seq desc) as rn
          from living) c
    join (select user_id, entry_id, min(seq) as added_seq from living where op = 'add'
          group by 1, 2) a
      on c.user_id = a.user_id and c.entry_id = a.entry_id
    where rn = 1""", changes=derive_sql("events", CHANGE), living="""
    select * from changes c where op <> 'delete' and not exists (
        select 1 from changes d where d.user_id = c.user_id and d.entry_id = c.entry_id
          and d.op = 'delete' and d.seq > c.seq)"""))
def manual_ledger(spark, sf_dir):
    return ledger.manual_ledger(derive(table(spark, sf_dir, "events"), CHANGE))


#: Every user-day of events as an upload, every event as a job.
DAY_UPLOAD = {"user_id": "cast(user_id as string)",
              "upload_id": "concat(cast(user_id as string), '-', "
                           "cast(cast(ts as date) as string))", "ts": "ts"}


@register("upload_history", duck.query(f"""
    select user_id, upload_id, created_at, tx_count, cast(rank as int) as rank from (
        select *, row_number() over (partition by user_id
                                     order by created_at desc, upload_id) as rank
        from (select user_id, upload_id, cast(max(ts) as date) as created_at,
                     count(*) as tx_count from days group by 1, 2))
    where rank <= {V.HISTORY_LENGTH}""", days=derive_sql("events", DAY_UPLOAD)))
def upload_history(spark, sf_dir):
    uploads = derive(table(spark, sf_dir, "events"), DAY_UPLOAD).groupBy(
        "user_id", "upload_id").agg(F.max("ts").cast("date").alias("created_at"),
                                    F.count(F.lit(1)).alias("tx_count"))
    return ledger.upload_history(uploads)


JOB = {"user_id": "cast(user_id as string)", "seq": "event_id",
       "job_id": "concat('job-', cast(event_id as string))",
       "status": "case event_type when 'error' then 'failed' when 'view' then 'pending' "
                 "when 'click' then 'processing' else 'complete' end"}


@register("jobs_by_user", duck.query(
    "select user_id, seq, job_id, status from jobs", jobs=derive_sql("events", JOB)))
def jobs_by_user(spark, sf_dir):
    return ledger.jobs_by_user(derive(table(spark, sf_dir, "events"), JOB))


@register("tx_list", duck.query("""
    select user_id, row_ord, tx_date, description, cast(amount as double) as amount, category
    from lab where category = 'food' and tx_type = 'debit'
      and tx_date between date '1996-01-01' and date '2000-12-31'""", "lab"))
def tx_list(spark, sf_dir):
    listed = ledger.transaction_list(frames.labelled(spark, sf_dir), since="1996-01-01",
                                     until="2000-12-31", category="food", tx_type="debit")
    return plain(listed.select("user_id", "row_ord", "tx_date", "description", "amount",
                               "category"))


@register("goal_progress", duck.query("""
    select user_id, name,
           round(least(1.0::double, cast(current_amount as double)
                                    / cast(target_amount as double)), 6) as progress,
           gap as remaining,
           cast(ceil(gap / nullif(cast(monthly_contribution as double), 0)) as bigint)
               as months_left,
           (coalesce(is_completed, false) or current_amount >= target_amount) as is_reached
    from (select *, greatest(cast(target_amount as double) - cast(current_amount as double),
                             0.0::double) as gap from goals)""", goals=frames.goals_sql()))
def goal_progress(spark, sf_dir):
    return ledger.goal_progress(frames.goals(spark, sf_dir))


@register("dashboard", duck.query("""
    select m.user_id, m.month, m.total_income, m.total_expenses, m.net_savings,
           m.tx_count as month_tx_count, s.category, s.slug, s.total, s.tx_count
    from (select *, row_number() over (partition by user_id order by month desc) as rn
          from months) m
    left join spend s on m.user_id = s.user_id and m.month = s.month where rn = 1""",
    "lab", categories=CATEGORIES, months=MONTHS.format("lab"), spend=SPEND.format("lab")))
def dashboard(spark, sf_dir):
    tx = materialise(frames.labelled(spark, sf_dir).select(
        "user_id", "tx_date", "tx_type", "amount", "category"), "labelled")
    return plain(ledger.dashboard(summary.monthly_summary(tx), summary.category_spend(tx)))


@register("result_doc")
def result_doc(spark, sf_dir):
    """Clean, classify and annotate all entries, then the result documents.

    Stages that are read more than once are written to the shared folder and read
    back column by column.
    """
    from tallyspark.operators.classify import classify
    from tallyspark.schema import ANNOTATIONS
    cleaned = materialise(clean.clean_transactions(frames.repeated(spark, sf_dir), materialise),
                          "cleaned")
    tx = materialise(classify(recurring.detect_recurring(cleaned)), "annotated")
    profiles = frames.profiles(spark, sf_dir)
    features = materialise(user_features(tx), "features")
    planned = recommend.with_plans(features, profiles, frames.budgets(spark, sf_dir),
                                   frames.goals(spark, sf_dir))
    return ledger.result_documents(
        summary.period_summary(tx), tx, recurring.recurring_summary(tx),
        clean.validation_report(tx.drop(*ANNOTATIONS)), summary.dominant_bank(tx),
        score_users(features, profiles), recommend.recommend(planned),
        forecast.cashflow_forecast(tx), forecast.forecast_summary(tx))


#: Fields of a transaction's record in their order; texts and dates are quoted.
_RECORD = {name: name not in ("row_ord", "amount", "balance", "is_recurring", "confidence")
           for name in [*STANDARD, "recurring_group", "is_recurring", "category", "confidence",
                        "classified_by"]}
_RECORD_SQL = "concat('{', concat_ws(',', " + ", ".join(
    f"""case when {name} is not null then '"{name}":' || """
    + (f"cast(to_json(cast({name} as varchar)) as varchar)" if quoted
       else f"cast({name} as varchar)") + " end"
    for name, quoted in _RECORD.items()) + "), '}')"


@register("transaction_records", duck.query(f"""
    select user_id, upload_id, row_ord, {_RECORD_SQL} as record from rec""", "rec"))
def transaction_records(spark, sf_dir):
    return ledger.transaction_documents(frames.annotated(spark, sf_dir))


SEARCH = "netflx subscripton web"


def _trigrams_sql(expr: str, other: str = "[^a-z0-9]+") -> str:
    words = (f"list_filter(regexp_split_to_array(lower({expr}), '{other}'), "
             f"lambda w: w <> '')")
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform("
            f"range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), "
            f"cast(i as bigint), 3)))))")


@register("trigram_search", duck.query(f"""
    select description, n, similarity from (
        select description, n, round(cast(len(list_intersect(a, b)) as double)
                                     / len(list_distinct(list_concat(a, b))), 6) as similarity
        from (select description, count(*) as n, {_trigrams_sql('description')} as a,
                     {_trigrams_sql(duck.lit(SEARCH))} as b from norm group by description))
    where similarity >= 0.3""", "norm"))
def trigram_search(spark, sf_dir):
    tx = clean.normalise_descriptions(clean.remove_noise(frames.standard(spark, sf_dir)))
    return search.trigram_search(tx, SEARCH)


_SENTENCES = "trim(unnest(regexp_split_to_array(text, '[.\\n]')))"
_GRAMS = _trigrams_sql("s", r"[^\p{L}\p{N}]+")


@register("search_documents", f"""
    with t as (select s, count(*) as n from (select {_SENTENCES} as s from documents)
               group by s),
    tg as materialized (select s, n, g from (select s, n, {_GRAMS} as g from t) where len(g) > 0),
    q as (select distinct s from (select {_SENTENCES} as s from benchmark)),
    qg as materialized (select s, g from (select s, {_GRAMS} as g from q) where len(g) > 0),
    p as (select qu.s as search, tu.s as text, count(*) as shared
          from (select s, unnest(g) as u from qg) qu join (select s, unnest(g) as u from tg) tu
               on qu.u = tu.u group by qu.s, tu.s)
    select search, text, round(shared::double / (len(qg.g) + len(tg.g) - shared), 6) as similarity, n
    from p join qg on qg.s = search join tg on tg.s = text
    where shared::double / (len(qg.g) + len(tg.g) - shared) >= 0.5""")
def search_documents(spark, sf_dir):
    """All sentences of the benchmark against all sentences of the documents."""
    def sentences(name, column):
        return table(spark, sf_dir, name).select(
            F.explode(F.split("text", "[.\\n]")).alias("s")).select(F.trim("s").alias(column))
    return search.search_many(sentences("documents", "description"),
                              sentences("benchmark", "search"), 0.5, cut=materialise)


#: Questions appended to the users' turns of conversations, by turns.
QUESTIONS = ["Where did my money go?", "How to SAVE more", "what is my health score",
             "do I earn enough", "hello there", "did I overspend or save"]
_QUESTION = "case conv_id % 6 " + " ".join(
    f"when {i} then '{q}'" for i, q in enumerate(QUESTIONS)) + " end"
MESSAGE = {"conv_id": "conv_id", "turn": "turn", "user_id": "cast(conv_id as string)",
           "message": f"concat(text, ' ', {_QUESTION})"}
_G = duck.grouped


def _chat_sql() -> str:
    values = {
        "rate": duck.fixed("rate", 1),
        "food_cut": _G("expenses * 0.15::double * 0.23::double", 0),
        "goal": _G("income * 0.3::double", 0), "savings": _G("savings", 0),
        "gap": _G("greatest(0.0::double, income * 0.3::double - savings)", 0),
        "income": _G("income", 0), "expenses": _G("expenses", 0)}
    *named, last = V.CHAT_INTENTS
    intent = duck.case([(duck.contains_any("lower(message)", words), duck.lit(name))
                        for name, words, _ in named], duck.lit(last[0]))
    reply = duck.case([(f"intent = {duck.lit(name)}", duck.fill(text, **values))
                       for name, _, text in named], duck.fill(last[2], **values))
    return f"""
        select conv_id, turn, user_id, intent, {reply} as reply from (
            select m.*, {intent} as intent, coalesce(total_income, 0) as income,
                   coalesce(total_expenses, 0) as expenses, coalesce(net_savings, 0) as savings,
                   coalesce(savings_rate_pct, 0) as rate
            from messages m left join period p on m.user_id = p.user_id)"""


@register("chat_intents", duck.query(
    _chat_sql(), "lab", period=PERIOD.format("lab"),
    messages=derive_sql("conversations", MESSAGE) + " where role = 'user'"))
def chat_intents(spark, sf_dir):
    messages = derive(table(spark, sf_dir, "conversations").where("role = 'user'"), MESSAGE)
    facts = summary.period_summary(frames.normal(spark, sf_dir))
    return assistant.reply(messages, facts).drop("message")


@register("stream_ingest", duck.query(f"""
    select {COLUMNS}, category, confidence, classified_by, is_recurring, recurring_group
    from s_rec""", "norm", **{
        "s1": EXACT.format("norm"), "s2": NEAR.format("s1"), "s3": FILL.format("s2"),
        "s_lab": duck.classified("s3"), "s_known": duck.known("s_lab"),
        "s_intervals": duck.intervals("s_known"),
        "s_rec": duck.recurring("s_known", "s_intervals")}))
def stream_ingest(spark, sf_dir):
    """Orders as a stream of entries: cleaned, classified and appended per micro-batch."""
    from tallyspark.streaming.ingest import run_available, table_stream
    stored = run_available(table_stream(spark, sf_dir))
    return plain(stored)


# -- learned classifier -------------------------------------------------------------

def documents(spark, sf_dir):
    """Labelled documents as training samples."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("description"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))


@register("train_classifier")
def train_classifier(spark, sf_dir):
    from tallyspark.operators.learn import train_classifier as train
    return train(documents(spark, sf_dir))[1]


FOLDS = """
    select doc_id as sample_id, label, cast((row_number() over (
             partition by label order by substr(md5(cast(doc_id as varchar)), 1, 3), doc_id)
             - 1) % 5 as int) as fold
    from (select doc_id, concat('q', cast(quality as varchar)) as label
          from labels join documents using (doc_id))"""


@register("stratified_folds", FOLDS)
def stratified_folds(spark, sf_dir):
    from tallyspark.operators.learn import stratified_folds as deal
    return deal(documents(spark, sf_dir).drop("description"))


@register("training_classes", f"""
    with f as ({FOLDS}), t as (select count(*) as n, count(distinct label) as k from f)
    select label, count(*) as samples, (select n from t)::double / ((select k from t) * count(*))
           as weight, min(c) as least_in_fold, max(c) as most_in_fold
    from f join (select label, fold, count(*) as c from f group by label, fold)
           using (label, fold) group by label""")
def training_classes(spark, sf_dir):
    """Samples, balanced weight and share of the folds of every label."""
    from tallyspark.operators.learn import balanced, stratified_folds as deal
    folds = balanced(deal(documents(spark, sf_dir).drop("description")))
    each = folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("c"),
                                              F.first("weight").alias("weight"))
    return each.groupBy("label").agg(
        F.sum("c").alias("samples"), F.first("weight").alias("weight"),
        F.min("c").alias("least_in_fold"), F.max("c").alias("most_in_fold"))


@register("score_classifier")
def score_classifier(spark, sf_dir):
    from tallyspark.operators.learn import fit_classifier, score_classifier as score
    model = fit_classifier(documents(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("description"), F.lit("debit").alias("tx_type"))
    return score(docs, model).drop("description")


PREDICTION = {"fold": "cast(doc_id % 5 as int)",
              "label": "concat('q', cast(quality as string))",
              "prediction": "case when n_chars > 800 then 'q1' else 'q0' end"}


@register("macro_f1", duck.query(f"""
    select round(avg(f), 4) as cv_f1_macro_mean, round(stddev_pop(f), 4) as cv_f1_macro_std
    from (select fold, avg(2.0 * tp / (2 * tp + wrong)) as f
          from (select fold, name, sum(tp) as tp, sum(wrong) as wrong
                from (select fold, label as name, (label = prediction)::int as tp,
                             (label <> prediction)::int as wrong from predictions
                      union all
                      select fold, prediction, 0, (label <> prediction)::int from predictions)
                group by fold, name) group by fold)""",
    predictions=derive_sql("labels join documents using (doc_id)", PREDICTION)))
def macro_f1_query(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return macro_f1(derive(joined, PREDICTION))
