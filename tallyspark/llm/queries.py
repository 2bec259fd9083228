"""The registered queries of the corpus operators, and DuckDB SQL where it can say the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import (capfilters, decontaminate, langid, neardup, packing, pii, quality,
                            secretscan, sharding, tokenfile, vafile, vectorcodes, warc)
from tallyspark.llm.common import read, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


@register("op1_decontamination")
def op1(spark, sf_dir):
    """One row for each document and benchmark item that overlap."""
    return decontaminate.overlaps(read(spark, sf_dir, "documents"),
                                  read(spark, sf_dir, "benchmark"))


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op2_packing")
def op2(spark, sf_dir):
    """Every piece of every document with its place in a sequence."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@register("op8_token_file")
def op8(spark, sf_dir):
    """Documents as read back from directly addressable token files."""
    path = shared_folder(spark, "tokens")
    tokenfile.write(read(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def quality_sql() -> str:
    q = quality
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    judged = "line"
    for pattern, instead in q.MEANT:
        judged = f"regexp_replace({judged}, {quote(pattern)}, {quote(instead)}, 'g')"
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, {quote(q.WORD + '+')}) w from d),
p as (select rid, i, list_slice(w, i, i + {q.WINDOW - 1}) win
      from (select rid, w, unnest(range(1, len(w) - {q.WINDOW - 2})) i from w)),
c as (select rid, i, count(*) over (partition by rid, win) n from p),
r as (select rid, count(distinct pos) n_repeat_words
      from (select rid, unnest(range(i, i + {q.WINDOW})) pos from c where n > 1) group by rid),
l as (select rid, line, regexp_extract_all(line, {quote(q.WORD + '+')}) lw
      from (select rid, unnest(string_split(t, chr(10))) line from d)),
j as (select rid, line, lw, regexp_extract_all({judged}, {quote(q.WORD + '+')}) jw
      from l where len(lw) > 0),
m as (select rid, line, len(lw) n,
             len(list_filter(jw, lambda x: regexp_matches(x, {quote(q.RUN)}))) runs,
             len(list_filter(jw, lambda x: regexp_matches(x, {quote(q.SEPARATOR)}))) menu
      from j),
v as (select rid, line, n, case
        when runs > 0 and 5 * runs >= n then 'punctuation'
        when menu >= 2 and 5 * menu >= n
             and not regexp_matches(line, {quote(q.TABLE_ROW)}) then 'navigation'
        when n <= {q.NOTICE_WORDS} and regexp_matches(lower(line), {quote(q.NOTICE)})
        then 'boilerplate' end rule_ from m),
s as (select rid, count(*) - count(distinct line) n_dup_lines,
             coalesce(sum(n) filter (rule_ = 'punctuation'), 0) lp,
             coalesce(sum(n) filter (rule_ = 'navigation'), 0) ln,
             coalesce(sum(n) filter (rule_ = 'boilerplate'), 0) lb from v group by rid),
a as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
             length(regexp_replace(t, {quote(q.SYMBOL)}, '', 'g'))::bigint n_symbols,
             coalesce(n_dup_lines, 0)::bigint n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint n_repeat_words,
             coalesce(lp, 0)::bigint lost_punctuation, coalesce(ln, 0)::bigint lost_navigation,
             coalesce(lb, 0)::bigint lost_boilerplate
      from w left join s using (rid) left join r using (rid)),
b as (select *, n_words < {q.LEAST_WORDS}
                or 100 * n_repeat_words > {q.MOST_REPEATED} * n_words as base_failed from a)
select *, not base_failed and 100 * (lost_punctuation + lost_navigation + lost_boilerplate)
          <= {q.MOST_LOST} * n_words as kept from b"""


@register("op3_quality_rules", quality_sql())
def op3(spark, sf_dir):
    """Base measures, words lost to failing lines and the verdict of every document."""
    found = quality.assess(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"q_{x}").alias(x) for x in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "lost_punctuation", "lost_navigation", "lost_boilerplate", "base_failed", "kept")])


@register("op6_near_duplicates")
def op6(spark, sf_dir):
    """Component of every document by four-word shingles at 80 percent."""
    return neardup.groups(read(spark, sf_dir, "documents"), size=4, percent=80)


@register("op7_language_id")
def op7(spark, sf_dir):
    """Predicted language of every document; a third of the ids are held out of training."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    prototypes = langid.train(docs.where("not held_out"))
    return langid.predict(docs, prototypes, ("doc_id", "held_out"))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest from p),
r as (select *, case when payload_bytes >= 100 then
        min(page_id) over (partition by payload_digest) end first_ from q)
select page_id, payload_bytes, payload_digest,
       case when page_id <> first_ then 'revisit' else 'response' end record_type,
       case when page_id <> first_ then first_ end refers_to from r"""


@register("op4_warc", WARC_SQL)
def op4(spark, sf_dir):
    """Pages as read back from WARC archives."""
    path = shared_folder(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.read(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op10_sharding")
def op10(spark, sf_dir):
    """Every document's shard of 24 and its place there, by near equal bytes."""
    return sharding.shard(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The queries' key. A production job passes its own, kept outside the code.
PII_KEY = b"key of the registered queries"


@register("op5_pii")
def op5(spark, sf_dir):
    """Every document with pseudonyms for its personal values, and where they were."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, PII_KEY, found_col="found")
    return found.select("doc_id", "text", F.size("found").alias("n_found"), "found")


@register("op9_secret_scan")
def op9(spark, sf_dir):
    """Every candidate string of every document with the forest's verdict."""
    return secretscan.scan(read(spark, sf_dir, "documents"))


#: Floor of a quotient of integers, for a positive divisor.
def floored(a: str, n: str) -> str:
    return f"(({a}) - ((({a}) % ({n})) + ({n})) % ({n})) // ({n})"


def clusters_sql() -> str:
    v, d = vafile, vafile.DIMENSIONS
    far = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    rounds = "".join(f"""
a{r} as (select rid, k, x, far from (
    select rid, k, x, {far}::bigint far, row_number() over (
      partition by rid order by {far}, k) r from v, c{r}) where r = 1),""" + (f"""
m{r} as (select k, list(q order by pos) c from (
    select k, pos, {floored('sum(v)::bigint', 'count(*)')} q from (
      select k, generate_subscripts(x, 1) pos, unnest(x) v from a{r}) group by k, pos) group by k),
c{r + 1} as (select c{r}.k, coalesce(m{r}.c, c{r}.c) c from c{r} left join m{r} using (k)),"""
                        if r < v.ROUNDS else "") for r in range(v.ROUNDS + 1))
    last = v.ROUNDS
    return f"""
with e as (select row_number() over () rid, vec_id,
       list_transform(embedding, lambda t: floor({v.SCALE}::double * t::double)::bigint) x
       from embeddings where len(embedding) = {d}
       and len(list_filter(embedding, lambda t: isfinite(t))) = {d}),
v as materialized (select * from e),
c0 as (select row_number() over (order by h, x) - 1 k, x c from (
       select sha256('2:' || vec_id) h, x from v order by h nulls last, x limit {v.CENTROIDS})),
{rounds}
s as (select k, sum(far)::bigint s from a{last} group by k),
f as (select k, sha256(array_to_string(c, ',')) h from c{last})
select vec_id, k::int as cluster, far as distance, s as cluster_inertia,
       (select sum(s)::bigint from s) as inertia, h as centroid_sha256
from a{last} join v using (rid) join s using (k) join f using (k)"""


def codes_sql() -> str:
    v = vectorcodes
    far = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    rounds = "".join(f"""
a{r} as (select rid, p, k, x, far from (
    select rid, v.p, k, x, {far}::bigint far, row_number() over (
      partition by rid, v.p order by {far}, k) r from v join c{r} on v.p = c{r}.p) where r = 1),"""
                     + (f"""
m{r} as (select p, k, list(q order by pos) c from (
    select p, k, pos, {floored('sum(v)::bigint', 'count(*)')} q from (
      select p, k, generate_subscripts(x, 1) pos, unnest(x) v from a{r})
    group by p, k, pos) group by p, k),
c{r + 1} as (select c{r}.p, c{r}.k, coalesce(m{r}.c, c{r}.c) c
             from c{r} left join m{r} on c{r}.p = m{r}.p and c{r}.k = m{r}.k),"""
                        if r < v.ROUNDS else "") for r in range(v.ROUNDS + 1))
    last = v.ROUNDS
    return f"""
with e as (select row_number() over () rid, vec_id, label,
       list_transform(embedding, lambda t: floor({v.SCALE}::double * t::double)::bigint) y
       from embeddings where len(embedding) > 0
       and len(list_filter(embedding, lambda t: isfinite(t))) = len(embedding)),
v as materialized (select rid, p, list_slice(y, p * (len(y) // {v.PARTS}) + 1,
                          (p + 1) * (len(y) // {v.PARTS})) x
      from e, range({v.PARTS}) t(p)),
f as (select rid, row_number() over (order by vec_id, y) - 1 k from e
      order by vec_id nulls last, y limit {v.ENTRIES}),
c0 as (select p, k, x c from v join f using (rid)),
{rounds}
o as (select rid, string_agg(printf('%02x', k), '' order by p) code, sum(far)::bigint error
      from a{last} group by rid),
l as (select rid, code, error, vec_id, label from o join e using (rid)),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) h from c{last})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       h as codebooks_sha256 from l, h"""


@register("op11_clusters", clusters_sql())
def op11(spark, sf_dir):
    """Every vector's cluster after five rounds of k-means over a VA-file."""
    return vafile.clusters(read(spark, sf_dir, "embeddings"))


@register("op12_vector_codes", codes_sql())
def op12(spark, sf_dir):
    """Every vector's product code after six rounds of training."""
    return vectorcodes.codes(read(spark, sf_dir, "embeddings"))


@register("op13_near_vectors")
def op13(spark, sf_dir):
    """Every vector's links and component at a cosine of 0.95."""
    return capfilters.groups(read(spark, sf_dir, "embeddings"))
