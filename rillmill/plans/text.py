"""Queries on style, titles, sentiment, collocations, keyness, hashes and subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmill.functions import text as X
from rillmill.functions.pythonic import alias_hits, common_tokens, moving_ttr
from rillmill.operators import language as L
from rillmill.sources.tables import table

KEYWORDS = "license|copyright|confidential|password"
ALIASES = {"licence": [r"(?i)\blicen[cs]ed?\b"], "mit": [r"\bMIT\b"], "apache": [r"(?i)\bapache(?:[\s\-]+license)?\b"], "gpl": [r"\bA?GPL\b", r"(?i)\bgeneral public license\b"]}
PATTERNS = (("english", "en.*"), ("hot", "*.src0"), ("all", ">"), ("german_tail", "de.>"), ("none", "en.src0.more"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def style_features(spark, sf_dir):
    """A row of style figures for each document."""
    df = X.style_features(_docs(spark, sf_dir).select("doc_id", "text"), "text")
    return df.select("doc_id", *(F.round(n, 6).alias(n) if n[:2] != "n_" else n for n in df.columns if n != "doc_id"))


def vocabulary_richness(spark, sf_dir):
    """Mean share of different tokens in windows of 50."""
    return _docs(spark, sf_dir).select("doc_id", F.round(moving_ttr(X.tokens(F.col("text"))), 10).alias("mattr"))


def _titles(spark, sf_dir):
    """The title of each page against the first sentence of its first paragraph, or all of it if no sentence ends."""
    p = table(spark, sf_dir, "pages")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", 1), "<[^>]*>", " "), r"\s+", " "))
    return p.select("page_id", X.html_title(F.col("html")).alias("title"), F.regexp_extract(body, r"^.*?[.!?](?=\s|$)|^.*", 0).alias("source")).where("title is not null and title <> '' and source <> ''")


def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


def stripped_titles(spark, sf_dir):
    p = table(spark, sf_dir, "nation").crossJoin(F.broadcast(table(spark, sf_dir, "region").select(F.explode(F.array(*map(F.lit, (" - Wikipedia", " | TechCrunch", " — The New York Times", " | Other")))).alias("tail")).distinct()))
    return p.select("n_nationkey", "tail", X.strip_suffix(F.concat("n_name", "tail")).alias("title"))


def title_metrics(spark, sf_dir):
    """Edit distance, token ratio, similarity and punctuation of two titles."""
    a, b = F.col("title"), F.col("source")
    distance = F.levenshtein("title", "source")
    return _titles(spark, sf_dir).select(
        "page_id",
        (a == b).alias("same"),
        (F.lower(a) == F.lower(b)).alias("same_folded"),
        F.round(distance / F.greatest(F.length(a), F.length(b)), 6).alias("distance"),
        F.round(F.try_divide(F.size(X.title_tokens(a)), F.size(X.title_tokens(b))), 6).alias("ratio"),
        F.round(X.jaccard(X.content_tokens(a), X.content_tokens(b)), 6).alias("similarity"),
        F.size(F.filter(X.found(a, r"\([^()]*\)"), lambda m: ~F.contains(F.lower(b), F.lower(F.trim(F.substring(m, F.lit(2), F.length(m) - 2)))))).alias("asides"),
        (X.occurrences(a, ".") - X.occurrences(b, ".")).alias("more_stops"),
        a.rlike(r"\[(?:pdf|video|audio|paywall|\d{4})\]").alias("tagged"),
    )


def title_relations(spark, sf_dir):
    """How each page's title relates to its first paragraph, with the longest common subsequence of both token lists."""
    a, b = F.col("title"), F.col("source")
    ta, tb = X.title_tokens(a), X.title_tokens(b)
    share = F.try_divide(common_tokens(ta, tb), F.least(F.size(ta), F.size(tb)))
    relation = X.title_relation(a == b, F.lower(a) == F.lower(b), F.levenshtein("title", "source") / F.greatest(F.length(a), F.length(b)), F.try_divide(F.size(ta), F.size(tb)), F.col("common"), X.jaccard(X.content_tokens(a), X.content_tokens(b)))
    return _titles(spark, sf_dir).withColumn("common", F.coalesce(share, F.lit(0.0))).select("page_id", F.round("common", 6).alias("common"), relation.alias("relation"))


def keyword_relevance(spark, sf_dir):
    hit = F.lower("text").rlike(rf"\b(?:{KEYWORDS})\b")
    return _docs(spark, sf_dir).groupBy("source").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("relevant"), F.count("*").alias("n"))


def alias_scan(spark, sf_dir):
    """Every mention with its place, and the sentiment of what surrounds it."""
    hits = _docs(spark, sf_dir).withColumn("hit", F.explode(alias_hits(F.col("text"), ALIASES)))
    return hits.select("doc_id", "hit.id", "hit.raw", "hit.start", "hit.end", X.sentiment_around(F.col("text"), F.col("hit.start")).alias("sentiment"))


def sentiment_window(spark, sf_dir):
    """Sentiment around the first mention of a licence in each document that has one."""
    at = F.instr(F.lower("text"), "license") - 1
    return _docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", at.alias("place"), X.sentiment_around(F.col("text"), at).alias("near"), X.sentiment(F.col("text")).alias("whole"))


def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.word_count(F.col("text")).alias("words"))


def content_hashes(spark, sf_dir):
    """Documents by the hash of their text, and the smallest id that has it."""
    return _docs(spark, sf_dir).where("text is not null").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def json_from_prose(spark, sf_dir):
    """Fields of a JSON object that stands in running text."""
    prose = F.concat(F.lit("Here it is: ```json\n"), F.col("props"), F.lit("\n``` as asked."))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.json_in_prose(prose), "$.k").cast("bigint").alias("k"))


def bigram_llr(spark, sf_dir):
    """Collocations of each language by log-likelihood ratio and by Poisson surprise."""
    return L.collocations(_docs(spark, sf_dir), ["lang"], F.col("text")).select("lang", "left", "right", "joint", F.round("g2", 4).alias("g2"), F.round("surprise", 4).alias("surprise"))


def log_odds_lang(spark, sf_dir):
    """Words that tell English documents from the others."""
    words = _docs(spark, sf_dir).select((F.coalesce("lang", F.lit("")) == "en").alias("en"), F.explode(X.tokens(F.col("text"))).alias("word"))
    counts = words.groupBy("word", "en").agg(F.count("*").alias("n"))
    return L.log_odds(counts, "word", "en", "n").select("word", F.round("z", 5).alias("z"))


def model_perplexity(spark, sf_dir):
    """Perplexity of each benchmark text under a smoothed bigram model of the documents."""
    model = L.KneserNey(_docs(spark, sf_dir), "doc_id", X.tokens(F.col("text")), order=2, modified=True)
    out = model.perplexity(table(spark, sf_dir, "benchmark"), "item_id", X.tokens(F.col("text")))
    return out.select("item_id", "n", F.round("perplexity", 4).alias("perplexity"))


def subject_matches(spark, sf_dir):
    """Documents whose subject, language and source, matches a wildcard pattern."""
    patterns = spark.createDataFrame(PATTERNS, "name string, pattern string").withColumn("regex", X.subject_regex(F.col("pattern")))
    subject = F.concat_ws(".", "lang", "source")
    return _docs(spark, sf_dir).select("doc_id", subject.alias("subject")).join(F.broadcast(patterns), F.expr("subject rlike regex")).groupBy("name", "subject").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    style_features, vocabulary_richness, page_titles, stripped_titles, title_metrics, title_relations, keyword_relevance, alias_scan, sentiment_window, word_counts, content_hashes,
    json_from_prose, bigram_llr, log_odds_lang, model_perplexity, subject_matches,
)}

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')"
_quote = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_occurs = lambda low, p: f"(length({low}) - length(replace({low}, '{p.replace(chr(39), chr(39) * 2)}', ''))) // {len(p)}"
_rate = lambda x: f"coalesce(round(100.0 * ({x}) / nullif(len(toks), 0), 6), 0)"
_lexicon = ",\n       ".join(
    _rate(" + ".join([f"len([t for t in toks if list_contains([{_quote(words)}], t)])", *(_occurs("low", p) for p in phrases)])) + f" as {k}_rate" for k, (words, phrases) in X.LEXICONS.items()
)
_RAW = "'[a-zA-Z0-9]+(?:''[a-zA-Z]+)?'"
_sentiment = lambda t: f"cast(sign(len([w for w in regexp_extract_all({t}, '[A-Za-z]+') if list_contains([{_quote(X.POSITIVE)}], lower(w))]) - len([w for w in regexp_extract_all({t}, '[A-Za-z]+') if list_contains([{_quote(X.NEGATIVE)}], lower(w))])) as integer)"
_META = r"""(?is)<meta\s+[^>]*(?:property|name)=["'']{}["''][^>]*content=["'']([^"'']*)["'']"""
_TITLE_RAW = ", ".join(f"nullif(trim(regexp_extract(html, '{_META.format(k)}', 1)), '')" for k in ("og:title", "twitter:title")) + r", nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"
_TITLE = f"coalesce({_TITLE_RAW})"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_e}', '{_c}')"
_TITLE = rf"trim(regexp_replace({_TITLE}, '\s+', ' ', 'g'))"
_TITLES = rf"""select * from (select page_id, {_TITLE} as title,
       coalesce(nullif(regexp_extract(body, '^(.*?[.!?])(?:\s|$)', 1), ''), body) as source
       from (select *, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as body from pages))
       where title is not null and title <> '' and source <> ''"""
_ttok = lambda c: f"[t for t in string_split_regex(lower({c}), '[^a-z0-9''À-ſ]+') if t <> '']"
_ctok = lambda c: f"[t for t in string_split_regex(lower({c}), '[^a-z0-9''À-ſ]+') if t <> '' and not list_contains([{_quote(X.STOP_WORDS)}], t)]"
# DuckDB counts edits of bytes, so each letter of several bytes is replaced by a character of one
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüáúàâë"
_bytes = lambda c: f"translate({c}, '{_LETTERS}', {' || '.join(f'chr({k})' for k in [*range(1, 9), *range(14, 32)][: len(_LETTERS)])})"
_STRIP = "n_name || tail"
for _p in X.SITE_SUFFIXES:
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '')"

ORACLE_SQL = {
    "style_features": rf"""
with a as (select doc_id, coalesce(text, '') as text from documents),
     b as (select *, lower(text) as low, {_TOKENS} as toks, regexp_extract_all(text, {_RAW}) as raw,
                  [len(regexp_extract_all(s, {_RAW})) for s in string_split_regex(text, '[.!?]+') if regexp_matches(s, '\S')] as sent,
                  [len(regexp_extract_all(s, {_RAW})) for s in string_split_regex(text, '\n\s*\n+') if regexp_matches(s, '\S')] as para,
                  [x for x in string_split(text, chr(10)) if regexp_matches(x, '\S')] as lines from a)
select doc_id, len(toks) as n_tokens, length(text) as n_chars, len(sent) as n_sentences, len(para) as n_paragraphs,
       coalesce(round(list_avg(sent), 6), 0) as sentence_mean,
       case when len(sent) < 2 then 0 else round(list_stddev_pop(sent), 6) end as sentence_sd,
       coalesce(round(list_avg([length(t) for t in toks]), 6), 0) as word_mean, coalesce(round(list_avg(para), 6), 0) as paragraph_mean,
       {_lexicon},
       {_rate(r"len(regexp_extract_all(text, 'https?://\S+'))")} as link_rate,
       coalesce(round(list_sum([length(x) for x in regexp_extract_all(text, '`[^`]*`')]) / nullif(length(text), 0), 6), 0) as code_fraction,
       {_rate(r"len(regexp_extract_all(text, '\b\d[\d.,]*\b'))")} as number_rate,
       {_rate("len([i for i in range(2, len(raw) + 1) if regexp_matches(raw[i], '^[A-Z]') and raw[i] <> 'I' and regexp_matches(raw[i - 1], '^[A-Z]') and raw[i - 1] <> 'I'])")} as name_rate,
       coalesce(round(len([x for x in lines if regexp_matches(x, '^\s*>')]) / nullif(len(lines), 0), 6), 0) as quote_rate,
       {_rate(_occurs("text", "?"))} as question_rate, {_rate(_occurs("text", "!"))} as exclamation_rate
from b""",
    "vocabulary_richness": f"""
with t as (select doc_id, {_TOKENS} as toks from documents)
select doc_id, case when coalesce(len(toks), 0) = 0 then 0
                    when len(toks) < 50 then round(len(list_distinct(toks)) / len(toks), 10)
                    else round(cast(list_sum([len(list_distinct(toks[i : i + 49])) for i in range(1, len(toks) - 48)]) as double) / 50 / (len(toks) - 49), 10) end as mattr
from t""",
    "page_titles": f"select page_id, {_TITLE} as title from pages",
    "stripped_titles": f"select n_nationkey, tail, {_STRIP} as title from nation, (select unnest([' - Wikipedia', ' | TechCrunch', ' — The New York Times', ' | Other']) as tail)",
    "title_metrics": rf"""
select page_id, title = source as same, lower(title) = lower(source) as same_folded, round(levenshtein({_bytes('title')}, {_bytes('source')}) / greatest(length(title), length(source)), 6) as distance,
       round(len({_ttok("title")}) / nullif(len({_ttok("source")}), 0), 6) as ratio,
       coalesce(round(len(list_intersect({_ctok("title")}, {_ctok("source")})) / nullif(len(list_distinct(list_concat({_ctok("title")}, {_ctok("source")}))), 0), 6), 0) as similarity,
       len([m for m in regexp_extract_all(title, '\([^()]*\)') if not contains(lower(source), lower(trim(substring(m, 2, length(m) - 2))))]) as asides,
       length(title) - length(replace(title, '.', '')) - length(source) + length(replace(source, '.', '')) as more_stops,
       regexp_matches(title, '\[(?:pdf|video|audio|paywall|\d{{4}})\]') as tagged
from ({_TITLES})""",
    "title_relations": f"""
with t as ({_TITLES}),
     w as (select *, {_ttok("title")} as a, {_ttok("source")} as b, {_ctok("title")} as ca, {_ctok("source")} as cb, levenshtein({_bytes("title")}, {_bytes("source")}) / greatest(length(title), length(source)) as d from t),
     r as (select *, list_reduce(list_concat([[0 for y in b]], [[cast(x = y as integer) for y in b] for x in a]),
                       lambda acc, e: [list_max([case when e[i] = 1 then coalesce(acc[i - 1], 0) + 1 else acc[i] end for i in range(1, j + 1)]) for j in range(1, len(e) + 1)]) as last from w),
     c as (select *, coalesce(coalesce(last[len(last)], 0) / nullif(least(len(a), len(b)), 0), 0) as common, len(a) / nullif(len(b), 0) as ratio,
                  coalesce(len(list_intersect(ca, cb)) / nullif(len(list_distinct(list_concat(ca, cb))), 0), 0) as alike from r)
select page_id, round(common, 6) as common,
       case when title = source then 'identical' when lower(title) = lower(source) or d < 0.05 then 'near-identical' when ratio < 0.7 and common > 0.6 then 'clipped' when ratio > 1.3 and common > 0.6 then 'expanded'
            when common > 0.4 and alike > 0.5 then 'rephrased' else 'divergent' end as relation from c""",
    "keyword_relevance": rf"select source, cast(coalesce(sum(case when regexp_matches(lower(text), '\b(?:{KEYWORDS})\b') then 1 else 0 end), 0) as bigint) as relevant, count(*) as n from documents group by 1",
    "sentiment_window": f"""
with a as (select doc_id, text, instr(lower(text), 'license') - 1 as place from documents where contains(lower(text), 'license')),
     b as (select *, substring(text, greatest(0, place - 120) + 1, least(length(text), place + 120) - greatest(0, place - 120)) as part from a)
select doc_id, place, {_sentiment("part")} as near, {_sentiment("text")} as whole from b""",
    "word_counts": r"select doc_id, len([w for w in string_split_regex(text, '\s+') if w <> '']) as words from documents",
    "content_hashes": "select sha256(text) as key, count(*) as n, min(doc_id) as first from documents where text is not null group by 1",
    "json_from_prose": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "bigram_llr": f"""
with t as (select lang, {_TOKENS} as toks from documents),
     p as (select lang, unnest(range(1, len(toks))) as i, toks from t),
     c as (select lang, toks[i] as a, toks[i + 1] as b, count(*) as joint from p group by 1, 2, 3),
     m as (select *, cast(sum(joint) over (partition by lang, a) as double) as l, cast(sum(joint) over (partition by lang, b) as double) as r, cast(sum(joint) over (partition by lang) as double) as n, cast(joint as double) as j from c),
     f as (select *, case when joint < 50 then list_sum([ln(i) for i in range(1, joint + 1)]) else j * ln(j) - j + 0.5 * ln(2 * pi() * j) + 1 / (12 * j) end as fact from m where joint >= 5)
select lang, a as left, b as right, joint,
       round(2 * (j * ln(j * n / (l * r)) + case when l > j then (l - j) * ln((l - j) * n / (l * (n - r))) else 0 end
         + case when r > j then (r - j) * ln((r - j) * n / ((n - l) * r)) else 0 end
         + case when n - l - r + j > 0 then (n - l - r + j) * ln((n - l - r + j) * n / ((n - l) * (n - r))) else 0 end), 4) as g2,
       round(fact - j * ln(l * r / n) + l * r / n, 4) as surprise
from f where lang is not null""",
    "log_odds_lang": f"""
with w as (select coalesce(lang, '') = 'en' as en, unnest({_TOKENS}) as word from documents),
     c as (select word, cast(count(*) filter (en) as double) as a, cast(count(*) filter (not en) as double) as b from w group by 1),
     s as (select *, sum(a) over () as na, sum(b) over () as nb from c)
select word, round((ln((2 * a + b) / (2 * na + nb - 2 * a - b)) - ln((2 * b + a) / (2 * nb + na - 2 * b - a))) / sqrt(1 / (2 * a + b) + 1 / (2 * b + a)), 5) as z
from s where 2 * na + nb - 2 * a - b > 0 and 2 * nb + na - 2 * b - a > 0""",
    "model_perplexity": f"""
with d as (select {_TOKENS} as toks from documents), b as (select item_id, {_TOKENS} as toks from benchmark),
     g as (select toks[i] as u, toks[i + 1] as v, cast(count(*) as double) as c from (select toks, unnest(range(1, len(toks))) as i from d) group by 1, 2),
     k as (select cast(count(*) filter (c = 1) as double) as n1, cast(count(*) filter (c = 2) as double) as n2, cast(count(*) filter (c = 3) as double) as n3, cast(count(*) filter (c = 4) as double) as n4 from g),
     y as (select *, n1 / (n1 + 2 * n2) as y from k),
     e as (select *, greatest(0, 1 - 2 * y * n2 / n1) as d1, case when n3 > 0 then greatest(0, 2 - 3 * y * n3 / n2) else greatest(0, 1 - 2 * y * n2 / n1) end as d2 from y),
     f as (select case when n1 > 0 and n2 > 0 then d1 else 0.5 end as d1, case when n1 > 0 and n2 > 0 then d2 else 0.5 end as d2,
                  case when not (n1 > 0 and n2 > 0) then 0.5 when n4 > 0 then greatest(0, 3 - 4 * y * n4 / n3) else d2 end as d3 from e),
     l as (select u, v, c, case when c >= 3 then d3 when c >= 2 then d2 else d1 end as d from g, f),
     h as (select u, sum(c) as s, sum(d) as ds from l group by 1),
     one as (select v, count(*) / (select count(*) from g) as p from g group by 1),
     q as (select item_id, toks[i] as u, toks[i + 1] as v from (select item_id, toks, unnest(range(1, len(toks))) as i from b)),
     p as (select item_id, case when h.u is null then coalesce(one.p, 0) else coalesce(greatest(l.c - l.d, 0), 0) / h.s + h.ds / h.s * coalesce(one.p, 0) end as p
           from q left join l on l.u = q.u and l.v = q.v left join h on h.u = q.u left join one on one.v = q.v)
select item_id, count(*) as n, round(exp(-avg(ln(greatest(p, 1e-300)))), 4) as perplexity from p group by 1""",
    "subject_matches": r"""
with p(name, r) as (values ('english', '^en\.[^.]+$'), ('hot', '^[^.]+\.src0$'), ('all', '^.+$'), ('german_tail', '^de\..+$'), ('none', '^en\.src0\.more$'))
select name, subject, count(*) as n from (select concat_ws('.', lang, source) as subject from documents) d join p on regexp_matches(subject, r) group by 1, 2""",
}
