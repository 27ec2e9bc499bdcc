"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-zA-Z0-9]+(?:'[a-zA-Z]+)?"
SENTENCE_END, PARAGRAPH_END = "[.!?]+", r"\n\s*\n+"
LEXICONS = {
    "hedge": (("arguably", "kinda", "maybe", "might", "perhaps", "possibly", "probably", "seems"), ("kind of", "sort of", "i guess", "i think")),
    "assertion": (("always", "certainly", "clearly", "definitely", "never", "obviously", "undoubtedly"), ("without question", "of course")),
    "first_person": (("i", "me", "mine", "my"), ()),
    "second_person": (("you", "your", "yours"), ()),
    "negation": (("never", "no", "not"), ("n't",)),
}
POSITIVE = (
    "accurate amazing awesome best better excellent fantastic fast favorite favourite great impressive improved improvement incredible "
    "love loved magic magical outperforms powerful prefer preferred reliable smart solid useful winning wins"
).split()
NEGATIVE = (
    "annoying awful broken buggy disappointing dumb failed failing fails frustrating garbage hallucinates hallucinating hallucination lazy overrated "
    "refused refuses regressed regression slop slow stupid sucks terrible trash useless worse worst wrong"
).split()
STOP_WORDS = "a an and are as at be but by for from has have in is it its of on or that the this to was were will with".split()
SITE_SUFFIXES = (
    r"\s+[|—–-]\s+The New York Times\s*$", r"\s+- (?:Wikipedia|BBC News|The Verge)\s*$", r"\s+\| (?:Hacker News|Ars Technica|TechCrunch)\s*$", r"\s+[|-] The Guardian\s*$",
)


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, with an inner apostrophe."""
    return found(F.lower(text), "[a-z0-9]+(?:'[a-z]+)?")


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def nonblank(parts: Column) -> Column:
    return F.filter(parts, lambda p: p.rlike(r"\S"))


def mean(xs: Column) -> Column:
    """Mean of an array of numbers, 0 for an empty one."""
    return F.coalesce(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs)), F.lit(0.0))


def deviation(xs: Column) -> Column:
    """Population deviation of an array, 0 for fewer than two numbers; from sums, so one pass."""
    n, s = F.size(xs), F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    q = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))))


def style_features(df: DataFrame, text: str) -> DataFrame:
    """df with its column ``text`` replaced by the style of that text; rates are for 100 tokens, 0 where there are none. A null text is an empty one.

    What several figures need is a column of a select below, so it is computed once. Tokens are counted by patterns over their joined list,
    which stays in generated code; for those of the lexicons a list of these alone is made. No token crosses a sentence or a paragraph, so all of them over
    the number of parts are the mean. Lower-case tokens are the others in lower case, but for two characters whose lower case has a letter of ASCII.
    """
    others = [c for c in df.columns if c != text]
    one = df.select(*others, F.coalesce(text, F.lit("")).alias("_x"))
    one = one.select(*others, "_x", F.lower("_x").alias("_low"))
    one = one.select(*others, "_x", "_low", F.array_join(found(F.col("_x"), TOKEN), " ").alias("_raw"))
    odd = F.contains("_x", F.lit("\u212a")) | F.contains("_x", F.lit("\u0130"))
    one = one.select("*", F.when(odd, F.array_join(tokens(F.col("_x")), " ")).otherwise(F.lower("_raw")).alias("_toks"))
    listed = lambda words: f"(?<![^ ])(?:{'|'.join(words)})(?![^ ])"
    size = lambda joined: F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)
    known = sorted({w for words, _ in LEXICONS.values() for w in words})
    one = one.select("*", size(F.col("_toks")).alias("_n"), size(F.col("_raw")).alias("_all"), F.array_join(found(F.concat(F.lit(" "), "_toks"), f" (?:{'|'.join(known)})(?![^ ])"), "").alias("_lex"))
    sizes = F.transform(nonblank(F.split("_x", SENTENCE_END)), lambda s: F.regexp_count(s, F.lit(TOKEN)))
    one = one.select("*", sizes.alias("_s"), F.size(nonblank(F.split("_x", PARAGRAPH_END))).alias("_p"))
    x, low, n, toks = F.col("_x"), F.col("_low"), F.col("_n"), F.col("_toks")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    per_100 = lambda v: F.coalesce(F.try_divide(100.0 * v, n), F.lit(0.0))
    among = lambda words: count(F.col("_lex"), listed(words))
    name = "(?!I(?![^ ]))[A-Z]"  # patterns begin with a character where they can, and look back from there: that is faster
    code = F.when(F.contains(x, F.lit("`")), F.length(x) - F.length(F.regexp_replace(x, "`[^`]*`", ""))).otherwise(0)
    columns = {
        "n_tokens": n,
        "n_chars": F.length(x),
        "n_sentences": F.size("_s"),
        "n_paragraphs": F.col("_p"),
        "sentence_mean": F.coalesce(F.try_divide(F.col("_all").cast("double"), F.size("_s")), F.lit(0.0)),
        "sentence_sd": deviation(F.col("_s")),
        "word_mean": F.coalesce(F.try_divide((F.length(toks) - n + 1).cast("double"), n), F.lit(0.0)),
        "paragraph_mean": F.coalesce(F.try_divide(F.col("_all").cast("double"), F.col("_p")), F.lit(0.0)),
        **{f"{k}_rate": per_100(reduce(lambda a, p: a + occurrences(low, p), phrases, among(words))) for k, (words, phrases) in LEXICONS.items()},
        "link_rate": per_100(F.when(F.contains(x, F.lit("http")), count(x, r"https?://\S+")).otherwise(0)),
        "code_fraction": F.coalesce(F.try_divide(code, F.length(x)), F.lit(0.0)),
        "number_rate": per_100(count(x, r"\d(?<=\b\d)[\d.,]*\b")),
        "name_rate": per_100(count(F.col("_raw"), f"[A-Z](?<![^ ].)(?!(?<=I)(?![^ ]))[^ ]* (?={name})")),
        "quote_rate": F.when(F.contains(x, F.lit(">")), F.coalesce(F.try_divide(count(x, r"(?:^|\n)[^\S\n]*>"), count(x, r"(?:^|\n)[^\S\n]*[^\s]")), F.lit(0.0))).otherwise(0.0),
        "question_rate": per_100(occurrences(x, "?")),
        "exclamation_rate": per_100(occurrences(x, "!")),
    }
    return one.select(*others, *(c.alias(k) for k, c in columns.items()))


def title_tokens(title: Column) -> Column:
    return F.filter(F.split(F.lower(title), r"[^a-z0-9'À-ſ]+"), lambda t: t != "")


def content_tokens(title: Column) -> Column:
    return F.filter(title_tokens(title), lambda t: ~t.isin(*STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets, 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def numeric_entities(text: Column) -> Column:
    """text with &#39; and &#x27; and their like decoded, up to U+FFFF; others stay as they are."""

    def piece(p: Column, i: Column) -> Column:
        tail = F.regexp_extract(p, r"^(?:\d{1,6}|[xX][0-9a-fA-F]{1,5});", 0)
        digits = F.regexp_extract(tail, r"[0-9a-fA-F]+", 0)
        code = F.when(F.lower(F.substring(tail, 1, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0xFFFF))
        return F.when(i == 0, p).when(known, F.concat(char, F.substring(p, F.length(tail) + 1, F.length(p)))).otherwise(F.concat(F.lit("&#"), p))

    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&#"), piece), "")).otherwise(text)


def html_title(html: Column) -> Column:
    """og:title, else twitter:title, else the title element; common and numeric entities are decoded, white space is folded; null if there is none."""
    meta = lambda key: F.regexp_extract(html, rf"(?is)<meta\s+[^>]*(?:property|name)=[\"']{key}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    raw = [meta("og:title"), meta("twitter:title"), F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)]
    title = numeric_entities(F.coalesce(*(F.when(F.trim(r) != "", r) for r in raw)))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(title, r"\s+", " "))


def strip_suffix(title: Column) -> Column:
    """title without the names of known sites at its end; every pattern is tried in turn."""
    return reduce(lambda t, p: F.regexp_replace(t, p, ""), SITE_SUFFIXES, title)


def title_relation(same: Column, same_folded: Column, distance: Column, ratio: Column, common: Column, similarity: Column) -> Column:
    """How one title relates to another, from the measures of both; the first case that holds."""
    much = common > 0.6
    return (
        F.when(same, "identical")
        .when(same_folded | (distance < 0.05), "near-identical")
        .when((ratio < 0.7) & much, "clipped")
        .when((ratio > 1.3) & much, "expanded")
        .when((common > 0.4) & (similarity > 0.5), "rephrased")
        .otherwise("divergent")
    )


def sentiment(text: Column) -> Column:
    """Sign of positive less negative words; null for a null text."""
    words = F.transform(found(text, "[A-Za-z]+"), F.lower)
    count = lambda lexicon: F.size(F.filter(words, lambda w: w.isin(*lexicon)))
    return F.signum(count(POSITIVE) - count(NEGATIVE)).cast("int")


def sentiment_around(text: Column, at: Column, radius: int = 120) -> Column:
    """Sentiment of the text within ``radius`` characters of place ``at``, from 0."""
    low = F.greatest(F.lit(0), at - radius)
    return sentiment(F.substring(text, low + 1, F.least(F.length(text), at + radius) - low))


def json_in_prose(text: Column) -> Column:
    """From the first brace to the last, fences and words around it left out; '' if there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def g2(joint: Column, left: Column, right: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair from its count, both marginals and the number of pairs."""
    cells = (
        (joint, left * right),
        (left - joint, left * (n - right)),
        (right - joint, (n - left) * right),
        (n - left - right + joint, (n - left) * (n - right)),
    )
    return 2 * reduce(lambda a, b: a + b, [F.when(o > 0, o * F.ln(o * n / e)).otherwise(0.0) for o, e in cells])


def log_factorial(k: Column) -> Column:
    """Sum of logarithms below 50, Stirling's series from there on."""
    small = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(k, F.lit(1)), F.lit(50)).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i))
    k = k.cast("double")
    return F.when(k < 50, small).otherwise(k * F.ln(k) - k + 0.5 * F.ln(2 * F.lit(3.141592653589793) * k) + 1 / (12 * k))


def poisson_surprise(joint: Column, left: Column, right: Column, n: Column) -> Column:
    rate = left * right / n
    return log_factorial(joint) - joint * F.ln(rate) + rate


def subject_regex(pattern: Column) -> Column:
    """Regular expression of a dotted subject pattern: ``*`` is one token, a last ``>`` one or more."""
    quoted = F.regexp_replace(pattern, r"([\\+?()\[\]{}^$|])", r"\\$1")
    one = F.regexp_replace(F.replace(quoted, F.lit("."), F.lit("\\.")), r"\*", "[^.]+")
    return F.concat(F.lit("^"), F.regexp_replace(one, ">$", ".+"), F.lit("$"))
