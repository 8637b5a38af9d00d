"""Text and date expressions that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that lose their accent, and signs that count as an apostrophe.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"
APOSTROPHES = "’‘ʼ`´"
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")

#: A default stop list for content words; callers may pass their own.
STOP_WORDS = (
    "au aux avec ce ces cet cette dans de des du elle en est et eux il ils je la le les leur leurs lui ma mais me mes moi mon ne nos notre nous "
    "on ou par pas plus pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous a y d l n s c j m t"
).split()


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_accents(c: str | Column) -> Column:
    """Lower case, without the accents of Latin letters; as many characters as before."""
    return F.translate(F.lower(_col(c)), ACCENTED, BARE)


def words_only(c: str | Column) -> Column:
    """Lower-case words: contractions split, numbers and ordinals out, punctuation as boundaries."""
    text = F.lower(F.translate(_col(c), APOSTROPHES + "\u00a0\u202f", "'" * len(APOSTROPHES) + "  "))
    text = F.regexp_replace(text, r"(^|[^\p{L}\p{N}_])n\s*[°º]\s*", "$1 ")
    text = F.regexp_replace(text, r"(^|[^\p{L}\p{N}_])nos?\s+([0-9])", "$1 $2")
    text = F.regexp_replace(text, r"(^|[^\p{L}\p{N}_])[0-9]+([.,][0-9]+)*(er|re|e|ème|eme|es|s)?($|[^\p{L}\p{N}_])", "$1 $4")
    return F.trim(F.regexp_replace(text, r"[^\p{L}]+", " "))


def fold(c: str | Column) -> Column:
    """A key for fuzzy matching: no accents, only a-z, 0-9 and single spaces."""
    return F.trim(F.regexp_replace(without_accents(c), "[^a-z0-9]+", " "))


def fold_aligned(c: str | Column) -> Column:
    """Like :func:`fold`, but one character for each, so that positions keep their meaning."""
    return F.regexp_replace(without_accents(c), "[^a-z0-9]", " ")


def fold_punctuated(c: str | Column) -> Column:
    """No accents, lower case, trimmed; punctuation stays."""
    return F.trim(without_accents(c))


def place_query(c: str | Column) -> Column:
    """A place name as searched: ligatures and st/ste spelt out."""
    text = F.trim(F.regexp_replace(F.replace(without_accents(c), F.lit("œ"), F.lit("oe")), "[^a-z0-9]+", " "))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.trim(F.replace(F.replace(padded, F.lit(" ste "), F.lit(" sainte ")), F.lit(" st "), F.lit(" saint ")))


def slug(c: str | Column) -> Column:
    return F.replace(fold(c), F.lit(" "), F.lit("-"))


def person_slug(name: str | Column, group: str | Column) -> Column:
    """``slug(name)--slug(group)``; without group the name alone."""
    tail = slug(F.coalesce(_col(group), F.lit("")))
    return F.when(tail != "", F.concat_ws("--", slug(name), tail)).otherwise(slug(name))


def safe_name(c: str | Column, default: str = "inconnu") -> Column:
    """Letters and digits without accents, other runs as ``_``; case stays."""
    text = F.translate(F.coalesce(_col(c), F.lit("")), ACCENTED + ACCENTED.upper(), BARE + BARE.upper())
    kept = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(kept != "", kept).otherwise(default)


def tokens(c: str | Column) -> Column:
    return F.filter(F.split(_col(c), r"\s+"), lambda t: t != "")


def content_tokens(words: Column, stop: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """Tokens of two characters or more, with a letter, that aren't stop words; repeats stay."""
    return F.filter(words, lambda t: (F.length(t) > 1) & t.rlike(r"\p{L}") & ~t.isin(list(stop)))


def ngrams(words: Column, n: int) -> Column:
    """Contiguous ``n``-grams joined with spaces; none where there are fewer than ``n`` words."""
    size = F.size(words)
    at = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
    grams = F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, n)))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))


def sentences(c: str | Column) -> Column:
    """Sentences of every line: a break follows . ! ? … before a capital or an opening guillemet."""
    marked = F.regexp_replace(_col(c), "([.!?…])[ \t\u00a0\u202f]+([A-ZÀ-ÖØ-Ý«])", "$1\n$2")
    return F.filter(F.transform(F.split(marked, "\n"), F.trim), lambda s: s != "")


def paragraphs(c: str | Column) -> Column:
    """Lines with single spaces, without blank ones."""
    lines = F.split(F.coalesce(_col(c), F.lit("")), "\n")
    return F.filter(F.transform(lines, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def shortened(c: str | Column, limit: int) -> Column:
    """At most ``limit`` characters: up to the last sentence end in the second half, else the last word and ``…``."""
    text = _col(c)
    head = F.substring(text, 1, limit)
    by_sentence = F.regexp_extract(head, r"(?s)^(.*[.?!]) ", 1)
    by_word = F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("…"))
    return F.when(F.length(text) <= limit, text).when(F.length(by_sentence) > limit // 2, by_sentence).otherwise(by_word)


def contains_phrase(text: str | Column, phrase: str | Column) -> Column:
    """Whether whole words of ``phrase`` stand in ``text``."""
    pad = lambda c: F.concat(F.lit(" "), _col(c), F.lit(" "))
    return F.contains(pad(text), pad(phrase))


def french_day(c: str | Column) -> Column:
    """The day of ``lundi 3 février 2025`` and the like, else null."""
    text = fold(c)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(text, r"(\d{1,2})(?:er)? ([a-z]+) (\d{4})", 2))
    parts = [F.regexp_extract(text, r"(\d{1,2})(?:er)? ([a-z]+) (\d{4})", i) for i in (3, 1)]
    return F.when(number > 0, F.try_to_date(F.concat_ws("-", parts[0], F.lpad(number.cast("string"), 2, "0"), F.lpad(parts[1], 2, "0")), "yyyy-MM-dd"))


def digit_runs(c: str | Column) -> Column:
    """All runs of digits, joined with commas."""
    return F.concat_ws(",", F.regexp_extract_all(_col(c), F.lit(r"(\d+)"), 1))


def iso_week(day: Column) -> Column:
    """``YYYY-Www`` of the ISO week of a date."""
    thursday = F.date_add(F.date_trunc("week", day).cast("date"), 3)
    return F.concat(F.date_format(thursday, "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def rate_per_thousand(count: str | Column, total: str | Column) -> Column:
    """0 where ``total`` is."""
    return F.when(_col(total) > 0, _col(count) * 1000.0 / _col(total)).otherwise(F.lit(0.0))


def share_of(part: str | Column, whole: str | Column) -> Column:
    """Null where ``whole`` is 0."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def shift_month(month: str | Column, by: int | Column) -> Column:
    """``YYYY-MM`` moved by a number of months."""
    return F.date_format(F.add_months(F.to_date(F.concat(_col(month), F.lit("-01"))), by if isinstance(by, Column) else F.lit(by)), "yyyy-MM")


def month_span(first: str | Column, last: str | Column) -> Column:
    """Months from ``first`` to ``last``, both counted."""
    year, month = (lambda c: F.substring(_col(c), 1, 4).cast("int")), (lambda c: F.substring(_col(c), 6, 2).cast("int"))
    return (year(last) - year(first)) * 12 + month(last) - month(first) + 1


def percent_text(share: str | Column, digits: int = 0) -> Column:
    """A share as French per cent; a share that isn't whole never reads 0 % or 100 %.

    Two more decimals are tried before the nearest value short of the bound is shown.
    """
    pct = F.coalesce(_col(share).cast("double"), F.lit(0.0)) * 100

    def shown(places: int) -> Column:
        return F.floor(pct * 10**places + 0.5) / 10**places

    def text(value: Column, places: int) -> Column:
        plain = F.format_string(f"%.{places}f", value.cast("double"))
        trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.concat(F.replace(trimmed, F.lit("."), F.lit(",")), F.lit(" %"))

    whole = lambda p: ((pct < 100) & (shown(p) >= 100)) | ((pct > 0) & (shown(p) <= 0))
    last = digits + 2
    edge = F.when(pct < 100, F.when(shown(last) >= 100, F.lit(100 - 10.0**-last)).otherwise(F.lit(10.0**-last)))
    out = F.when(~whole(digits), text(shown(digits), digits))
    for p in range(digits + 1, last + 1):
        out = out.when(~whole(p), text(shown(p), p))
    return out.otherwise(text(edge, last))


def paris_day(at: str | Column) -> Column:
    """The calendar day in Paris of a UTC timestamp."""
    return F.from_utc_timestamp(_col(at), "Europe/Paris").cast("date")


def constituency(code: str | Column, aliases: dict[str, str] | None = None) -> Column:
    """Department and number of a constituency code: two characters, three for 97 and 98, then the number."""
    text = _col(code)
    wide = F.substring(text, 1, 2).isin("97", "98")
    dept = F.when(wide, F.substring(text, 1, 3)).otherwise(F.substring(text, 1, 2))
    number = F.when(wide, F.substring(text, 4, 9)).otherwise(F.substring(text, 3, 9)).try_cast("int")
    for old, new in (aliases or {}).items():
        dept = F.when(dept == old, new).otherwise(dept)
    return F.struct(dept.alias("department"), number.alias("number"))


# What the agents of crawlers call themselves.
CRAWLERS = ("bot", "crawl", "spider", "slurp", "preview", "headless", "monitor")


def campaign(c: str | Column, limit: int = 40) -> Column:
    """A campaign's name as it is counted: lower case, letters, digits, ``-`` and ``_`` only, cut to ``limit``; null without any."""
    plain = F.substring(F.regexp_replace(without_accents(F.lower(_col(c))), r"[^a-z0-9_-]+", "-"), 1, limit)
    return F.nullif(F.regexp_replace(plain, "^-+|-+$", ""), F.lit(""))


def is_crawler(agent: str | Column) -> Column:
    """Whether a user agent is a machine's; an empty one is."""
    own = F.lower(F.coalesce(_col(agent), F.lit("")))
    return (own == "") | own.rlike("|".join(CRAWLERS))
