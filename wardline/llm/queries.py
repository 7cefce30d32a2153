"""The thirteen operators with their production parameters over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import divergence, jaccard, language, lines, maxent, media, packing, secrets, spelling, substring, tiling, tokens, urls

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 2,048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return tokens.token_counts(docs, public_tokenizers.path(TOKENIZER))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; four fifths of the labelled documents may teach."""
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.filter(~language.held_out()))
    found = language.predict(docs, profiles)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as samples in the chunk store, read back and described."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that come after an equal line or one within an edit distance of 1."""
    kept = lines.drop_near_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = """
with parts as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
rows as (
  select doc_id, pos, line
  from (select doc_id, unnest(range(len(parts))) as pos, unnest(parts) as line from parts) where length(line) >= 20),
lines as (select line, min(doc_id * 1000000 + pos) as first, length(line) as n from rows group by line),
halves as (
  select line, first, n, 'p' as side, left(line, n // 2) as half, n // 2 as h from lines
  union select line, first, n, 'p', left(line, (n - 1) // 2), (n - 1) // 2 from lines
  union select line, first, n, 's', right(line, n // 2), n // 2 from lines
  union select line, first, n, 's', right(line, (n - 1) // 2), (n - 1) // 2 from lines),
near as (
  select a.line, min(b.first) as near from halves a join halves b on a.side = b.side and a.h = b.h and a.half = b.half
  where a.line <> b.line and abs(a.n - b.n) <= 1 and levenshtein(a.line, b.line) <= 1 group by a.line),
cuts as (select line, least(first, coalesce(near, first)) as cut from lines left join near using (line)),
gone as (select doc_id, list(pos) as gone from rows join cuts using (line) where doc_id * 1000000 + pos > cut group by doc_id)
select doc_id, len(parts)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(case when gone is null then text else coalesce(array_to_string(
    list_transform(list_filter(range(len(parts)), lambda i: not list_contains(gone, i)), lambda i: parts[i + 1]), chr(10)), '') end) as kept_sha256
from parts left join gone using (doc_id)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; pages whose document is toxic or of low quality teach the mined rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    mined = urls.mine(pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "toxic", "quality"), bad)
    return urls.judge(pages, mined)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 4,096."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, in any order of its parts."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.group_similar(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 or more words that also start earlier."""
    return substring.drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the other sources of its language, and its 200 most over-represented terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
counts as (select lang, source, term, count(*)::hugeint as n, count(distinct d) as k from words group by all),
kept as (select lang, term, sum(n)::hugeint as total from counts group by all having sum(k) >= 3),
langs as (select lang, (select count(*) from kept where kept.lang = x.lang)::hugeint as v,
  coalesce((select sum(total) from kept where kept.lang = x.lang), 0)::hugeint as n from (select distinct lang from docs) x),
groups as (
  select x.lang, x.source, any_value(v) as v, coalesce(sum(c.n), 0)::hugeint as n
  from (select distinct lang, source from docs) x join langs using (lang)
  left join (select * from counts semi join kept using (lang, term)) c using (lang, source) group by all),
cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + g.v) as p,
    1 + (1000000000 * (k.total + 1)) // (l.n + l.v) as q
  from groups g join kept k using (lang) join langs l using (lang) left join counts c using (lang, source, term)),
sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from cells where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more with the more frequent word it is a variant of."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_variants"] = r"""
with recursive low as (
  select coalesce(doc_id::varchar, '') as name, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents where text is not null),
runs as (
  select name, run, count(*) as k
  from (select name, unnest(regexp_extract_all(text, '[a-z\x{C0}-\x{FF}]+')) as run from low) where length(run) >= 7 group by all),
bits as (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from (select unnest(range(256)) as i)),
steps as (select list(v order by i) as t from bits),
hashed as (
  select run, k, xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(name || ':' || run, ''),
      lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195, ord(x)::bigint - 64] end))),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as h
  from runs, steps),
typos as (
  select k, case when h % 31 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed),
words as (select word, sum(k)::bigint as n from typos where length(word) >= 7 group by word having sum(k) >= 2),
gaps as (
  select word, n, i, left(word, i - 1) || substr(word, i + 1) as gap from (select word, n, unnest(range(1, length(word) + 1))::int as i from words)),
near as (
  select a.word, a.n, b.word as near, b.n as near_n from gaps a join gaps b on a.gap = b.gap and a.i = b.i where a.word <> b.word
  union select g.word, g.n, w.word, w.n from gaps g join words w on g.gap = w.word
  union select w.word, w.n, g.word, g.n from gaps g join words w on g.gap = w.word),
best as (
  select word, any_value(n) as n, count(*) as n_near, max(near_n) as best_n, arg_min(near, (-near_n, near)) as best from near group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 10 * w.n then best end as form,
    case when best_n >= 10 * w.n then best_n end::bigint as form_n
  from words w left join best b on w.word = b.word),
chain as (
  select word, form as at from forms where form is not null
  union all select c.word, f.form from chain c join forms f on c.at = f.word where f.form is not null),
roots as (select c.word, c.at as root from chain c join forms f on c.at = f.word where f.form is null)
select f.word, f.form, coalesce(r.root, f.word) as root, f.n, f.n_near, f.form_n from forms f left join roots r on f.word = r.word
"""


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under counts and under the class-factored model."""
    return maxent.score(table(spark, sf_dir, "documents"))


for _run in (
    op6_token_counts, op4_language_id, op9_media_columns, op10_secret_scan, op5_line_dedup, op2_url_filter, op7_packing, op8_benchmark_tiling,
    op3_ngram_jaccard, op1_substring_dedup, op11_source_divergence, op12_lm_scoring, op13_spelling_variants,
):
    QUERIES[_run.__name__] = _run
