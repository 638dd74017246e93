"""Names, links, titles, dates and figures as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Endings dropped from a company name, once each, in this order.
SUFFIXES = ["pte ltd", "pte. ltd.", "pte ltd.", "ltd", "ltd.", "limited", "inc", "inc.", "corp", "corp.", "corporation", "holdings", "group", "singapore", "bank", "international"]
#: Trailing words that only qualify a name, dropped after the endings, once each, in this order.
DESCRIPTORS = ["platforms", "asia pacific", "stores", "store", "patisserie", "cafe", "restaurant", "bakery", "bar and grill", "bistro", "eatery", "kitchen", "studio"]
#: Aliases where no table is given.
ALIASES = {"dbs bank": "DBS", "sea limited": "Sea", "yeo's": "Yeo Hiap Seng", "ninja van": "Ninja Van"}
#: Words that name no company by themselves.
GENERIC = ["the", "and", "group", "asia", "sea", "singapore", "pacific", "global", "inc", "corp", "ltd", "limited", "holdings"]
#: Industry spellings.
INDUSTRY_OF = {
    "tech": "Tech", "technology": "Tech", "it": "Tech", "information technology": "Tech", "software": "Tech", "ecommerce": "Tech", "e-commerce": "Tech",
    "fintech": "Finance", "finance": "Finance", "banking": "Finance", "financial services": "Finance", "manufacturing": "Manufacturing", "retail": "Retail",
    "f&b": "F&B", "food & beverage": "F&B", "food and beverage": "F&B", "food & beverages": "F&B", "hospitality": "F&B", "real estate": "Real Estate", "property": "Real Estate",
    "healthcare": "Healthcare", "medical": "Healthcare", "pharma": "Healthcare", "pharmaceutical": "Healthcare", "education": "Education", "edtech": "Education",
    "media": "Other", "logistics": "Other", "transport": "Other", "shipping": "Other", "energy": "Other", "construction": "Other",
}
INDUSTRIES = ["Tech", "Finance", "Manufacturing", "Retail", "F&B", "Real Estate", "Healthcare", "Education", "Other"]
ISO = r"^\d{4}-\d{2}-\d{2}\z"


def strip_chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if not "\u0300" <= c <= "\u036f"))


@cache
def unaccented() -> Callable[[Column], Column]:
    """Letters without their combining marks, by canonical decomposition; Spark has no function for it."""
    return F.pandas_udf(without_marks, StringType())


@cache
def plain_letters() -> tuple[str, str, str]:
    """(letters, what each is without its marks, letters that can't be told alone as a class) of the Basic Multilingual Plane.

    A letter can be told alone if decomposition leaves one character of it or none, and none that is put in order with its
    neighbours; marks stand last among the letters, so translate drops them.
    """
    plain, marks, bare, odd = [], [], [], []
    for n in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        c = chr(n)
        left = [x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f"]
        if len(left) > 1 or any(map(unicodedata.combining, left)):
            odd.append(n)
        elif not left:
            marks.append(c)
        elif left != [c]:
            plain.append(c)
            bare.append(left[0])
    runs: list[list[int]] = []
    for n in odd:
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return "".join(plain + marks), "".join(bare), "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + r"\x{10000}-\x{10ffff}]"


def unmarked(c: Column) -> Column:
    """`unaccented`, which sees those texts only that have a letter that can't be told alone."""
    letters, bare, odd = plain_letters()
    ascii_only = F.length(c) == F.octet_length(c)
    # given to Python, other rows are null; Spark calls it for all rows, whatever stands around it
    told = unaccented()(F.when(~ascii_only & c.rlike(odd), c))
    return F.coalesce(told, F.when(ascii_only, c).otherwise(F.translate(c, letters, bare)))


def fold(c: Column) -> Column:
    """Accents dropped, apostrophes straightened, a spaced ampersand spelled out, spaces collapsed."""
    text = F.translate(unmarked(c), "‘’ʼ", "'''")
    spelled = F.when(text.contains("&"), F.regexp_replace(text, r"(?U)\s&\s", " and ")).otherwise(text)
    return F.trim(F.regexp_replace(spelled, r"(?U)\s+", " "))


@dataclass(frozen=True)
class Names:
    """The key dimension of a run: the aliases it went by and, where these are a frame, a written table (name, key) of every distinct company name."""

    table: DataFrame | None
    aliases: dict[str, str] | DataFrame | None = None


#: What names resolve by: lower-cased aliases with their canonical names (a frame has alias and canonical), a key dimension, or None for the fixed few.
Aliases = dict[str, str] | DataFrame | Names | None


def without_brackets(name: Column) -> Column:
    cut = F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*\z", "")), F.lit("")), name)
    return F.when(name.contains("("), cut).otherwise(name)


def shortened(bare: Column) -> Column:
    """A folded name without endings, descriptors and closing punctuation, in title case; may be blank.

    A folded name has single spaces and no letter that becomes an ASCII one in lower case, so endings are compared as text:
    a pattern each would cost some thirty times that.
    """
    endings = SUFFIXES + DESCRIPTORS
    # the last word finds the names that may have any ending; the steps are spent on them only
    some = F.substring_index(F.lower(bare), " ", -1).isin(sorted({e.split()[-1] for e in endings}))
    less = lambda name, e: F.when(F.lower(name).endswith(e), F.rtrim(F.left(name, F.length(name) - F.length(e)))).otherwise(name)
    plain = F.when(some, F.aggregate(F.array(*(F.lit(f" {e}") for e in endings)), bare, less)).otherwise(bare)
    return F.initcap(F.trim(F.regexp_replace(plain, r"[,;.]\z", "")))


def named_by(known: dict[str, str], fold: Column, bare: Column) -> list[Column]:
    """What fixed aliases make of a name as it stands and without brackets."""
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else None
    return [F.element_at(table, F.lower(c)) for c in (fold, bare)] if known else []


def normalize_company(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical company name: that of an alias, spelled out or left without brackets, else the name without its endings; what is left blank keeps its spelling.

    Steps that are used twice are worked out twice in one expression; `with_company_key` works them out once.
    """
    name = fold(raw)
    bare, known = without_brackets(name), ALIASES if aliases is None else aliases
    return F.coalesce(*named_by(known, name, bare), F.nullif(shortened(bare), F.lit("")), F.trim(raw))


def company_key(raw: Column, aliases: dict[str, str] | None = None) -> Column:
    return F.lower(F.trim(normalize_company(F.coalesce(raw, F.lit("")), aliases)))


def keyed_names(names: DataFrame, aliases: dict[str, str] | DataFrame | None = None, out: str = "key") -> DataFrame:
    """names with `out`, the company key of _name. A frame of aliases is joined, so it may be of any size.

    Each step is a column of its own, since Spark inlines no costly column that is used more than once.
    """
    d = names.withColumn("_fold", fold(F.col("_name")))
    d = d.withColumn("_bare", without_brackets(F.col("_fold")))
    d = d.withColumn("_short", shortened(F.col("_bare")))
    if isinstance(aliases, DataFrame):
        known = aliases.select(F.lower(F.trim("alias")).alias("_alias"), F.trim("canonical").alias("_to")).filter("_alias <> '' and _to <> ''").dropDuplicates(["_alias"])
        for n, c in enumerate(("_fold", "_bare")):
            d = d.join(known.select(F.col("_alias").alias(f"_a{n}"), F.col("_to").alias(f"_t{n}")), F.lower(c) == F.col(f"_a{n}"), "left")
        to = [F.col("_t0"), F.col("_t1")]
    else:
        to = named_by(ALIASES if aliases is None else aliases, F.col("_fold"), F.col("_bare"))
    key = F.lower(F.trim(F.coalesce(*to, F.nullif("_short", F.lit("")), F.trim("_name"))))
    return d.select(*names.columns, key.alias(out))


def with_company_key(df: DataFrame, out: str = "k", company: str = "company", aliases: Aliases = None) -> DataFrame:
    """df with the company key; null counts as blank.

    Fixed aliases cost a row less than moving it would, so its key is worked out where it stands. By a frame of aliases, keys are
    worked out once per distinct name of df, or taken from the run's key dimension, and joined.
    """
    d, given = df.withColumn("_name", F.coalesce(company, F.lit(""))), aliases.aliases if isinstance(aliases, Names) else aliases
    if not isinstance(given, DataFrame):
        return keyed_names(d.drop(out), given, out).drop("_name")
    if isinstance(aliases, Names) and aliases.table is not None:
        names = aliases.table.select(F.col("name").alias("_name"), F.col("key").alias(out))
    else:
        names = keyed_names(d.select("_name").distinct(), given, out)
    return d.join(names, "_name").drop("_name")


def event_id_for(key: Column, date: Column) -> Column:
    """slug-YYYY-MM of a company key, with `event` and `unknown` for what is missing."""
    slug = strip_chain(key, ("[^a-z0-9]+", "-"), (r"^-+|-+\z", ""))
    return F.concat(F.when(slug == "", "event").otherwise(slug), F.lit("-"), F.coalesce(F.nullif(F.substring(date, 1, 7), F.lit("")), F.lit("unknown")))


def normalize_url(url: Column) -> Column:
    """One key for the spellings of an article's address; the feed address that an id alone tells apart keeps it.

    Costly patterns are spent on addresses that hold what they look for.
    """
    u = F.coalesce(url, F.lit(""))
    u = F.when(u.contains("web.archive.org/web/"), F.regexp_replace(u, r"^https?://web\.archive\.org/web/\d+/", "")).otherwise(u)
    feed = F.when(F.lower(u).contains("layoffsg.com/feed?"), F.lower(F.regexp_extract(u, r"(?i)layoffsg\.com/feed\?[^#]*\bevent=([0-9a-z]+)", 1))).otherwise("")
    bare = F.regexp_replace(F.lower(F.rtrim(F.substring_index(F.substring_index(u, "?", 1), "#", 1), F.lit("/"))), r"^(?:https?://)?(?:www\.)?", "")
    rest = strip_chain(bare, (r"(?:^|/)amp(?=/|\z)", ""), (r"\.amp\z", ""), (r"/index\.html?\z", ""), ("/{2,}", "/"), (r"/+\z", ""))
    plain = F.when(bare.rlike(r"(?:^|[/.])amp|/index\.htm|//"), rest).otherwise(bare)
    return F.when(feed != "", F.concat(F.lit("https://layoffsg.com/feed?event="), feed)).otherwise(plain)


def title_fingerprint(title: Column) -> Column:
    """The first six words of a title without its source."""
    t = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r" [-–] [^-–\n]+\z", ""))
    return F.array_join(F.slice(F.split(F.trim(strip_chain(t, (r"[^a-z0-9\s]", " "), (r"\s+", " "))), " "), 1, 6), " ")


def gn_fingerprint(notes: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(notes, F.lit("")), r"\[gn:([^\]]*)\]", 1), F.lit(""))


def month_base(event_id: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(event_id, F.lit("")), r"^(.+?-\d{4}-(?:0[1-9]|1[0-2]))(?:-([a-z][a-z0-9-]*))?\z", 1), F.lit(""))


def event_key(event_id: Column, company: Column, date: Column, link: Column, row_idx: Column) -> Column:
    """The trimmed event id, else a key of the row's own."""
    own = F.concat(F.lit("__row__:"), company, F.lit("|"), date, F.lit("|"), F.coalesce(F.nullif(link, F.lit("")), row_idx.cast("string")))
    return F.coalesce(F.nullif(F.trim(event_id), F.lit("")), own)


def iso_date(c: Column) -> Column:
    """A date from YYYY-MM-DD text alone; anything else is null."""
    return F.when(c.rlike(ISO), F.try_to_date(c, "yyyy-MM-dd"))


#: What a date may look like once commas are gone and words begin with capitals.
DATE_FORMS = ["d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "yyyy/M/d", "M/d/yyyy", "yyyy-M-d"]
STAMP_FORMS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z"]


def parse_date(raw: Column) -> Column:
    """YYYY-MM-DD text of a date in any of the known forms, in UTC; null for anything else."""
    text = F.trim(raw)
    loose = F.trim(strip_chain(text, (",", ""), (r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+", ""), (r"\s+", " ")))
    named = F.regexp_replace(F.initcap(loose), r"(?i)\b(gmt|utc)\z", "GMT")
    days = [F.try_to_timestamp(named, F.lit(f)) for f in DATE_FORMS] + [F.try_to_timestamp(x, F.lit(f)) for f in STAMP_FORMS for x in (named if " z" in f or " Z" in f else loose,)]
    return F.when(text.rlike(ISO), text).otherwise(F.date_format(F.coalesce(*days), "yyyy-MM-dd"))


def guess_company(title: Column, aliases: dict[str, str] | None = None) -> Column:
    """The name before a headline's first layoff verb."""
    return normalize_company(F.coalesce(F.nullif(F.element_at(F.split(title, r"(?i)cuts?|lays? off|retrench|sheds?", 2), 1), F.lit("")), title), aliases)


def wayback_url(stamp: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit("/"), url)


def append_evidence(notes: Column, url: Column) -> Column:
    """notes with the address of the evidence, once."""
    base, link = F.trim(F.coalesce(notes, F.lit(""))), F.coalesce(url, F.lit(""))
    return F.when((link == "") | base.contains(link), base).otherwise(F.concat(F.when(base != "", F.concat(base, F.lit(" | "))).otherwise(""), F.lit("Evidence: "), link))


def map_industry(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", "Other").otherwise(normalize_industry(F.translate(raw, "_", " ")))


def month_label(month: Column) -> Column:
    """`Mon YY` of YYYY-MM."""
    return F.concat(F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMM"), F.lit(" "), F.substring(month, 3, 2))


def quarter_heading(quarter: Column) -> Column:
    """`Qn YYYY` of YYYY-Qn."""
    return F.concat_ws(" ", F.substring_index(quarter, "-", -1), F.substring_index(quarter, "-", 1))


#: What tells a layoff story.
LAYOFF_TERMS = ["layoff", "laid off", "job cut", "jobs cut", "retrench", "redundanc", "restructur", "downsiz", "workforce reduction", "headcount", "sheds jobs", "cuts jobs"]


def is_relevant(title: Column, snippet: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit("")))).rlike("|".join(LAYOFF_TERMS))


def host_is_excluded(url: Column, excluded: list[str]) -> Column:
    """Whether the host is one of these domains or below one; addresses that can't be read pass."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(reduce(lambda a, b: a | b, ((host == d) | host.endswith(f".{d}") for d in excluded), F.lit(False)), F.lit(False))


def match_text(company: Column, url: Column) -> Column:
    """What the rules read: the headline and the words of the address's path."""
    path = strip_chain(F.coalesce(url, F.lit("")), (r"^https?://[^/]+", ""), (r"(?s)[?#].*\z", ""), (r"[-_/.]", " "))
    return F.concat(F.coalesce(company, F.lit("")), F.lit(" "), path)


def normalize_industry(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    known = F.element_at(F.create_map(*(F.lit(x) for kv in INDUSTRY_OF.items() for x in kv)), low)
    return F.coalesce(known, *(F.when(low.contains(i.lower()), i) for i in INDUSTRIES), F.lit("Other"))


#: Headcount and share phrases, by priority.
JOBS = [
    r"(?i)(?:cut|laid\s*off|shed|trimmed?|axed?|slashed?|eliminated?)\s+(\d[\d,]*)\s*(?:jobs?|employees?|staff|roles?|positions?|workers?)",
    r"(?i)(?:reduce|cut|trim)\s+(?:its\s+)?(?:workforce|headcount|staff)\s+by\s+(\d[\d,]*)",
    r"(?i)retrench(?:ed|ing)?\s+(\d[\d,]*)\s*(?:jobs?|employees?|staff|roles?|workers?)",
    r"(?i)(\d[\d,]*)\s*(?:jobs?|employees?|staff|roles?|positions?|workers?)\s+(?:cut|axed|slashed|eliminated|affected)",
]
SHARES = [
    r"(?i)(?:cut|laid\s*off|shed|reduce)\s+(\d+(?:\.\d+)?)\s*%\s*(?:of\s+)?(?:its\s+)?(?:workforce|staff|employees|headcount)",
    r"(?i)(\d+(?:\.\d+)?)\s*%\s*(?:of\s+)?(?:its\s+)?(?:workforce|staff|employees|headcount)\s+(?:cut|axed|laid\s*off)",
    r"(?i)cutting\s+(?:about\s+)?(\d+(?:\.\d+)?)\s*%\s*(?:of\s+)?",
]


def extract_jobs(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in JOBS))


def jobs_number(text: Column) -> Column:
    return F.regexp_replace(extract_jobs(text), ",", "").try_cast("bigint")


def share_number(text: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in SHARES)).try_cast("double")


def row_quality(e: str = "", fields: dict[str, Column] | None = None) -> Column:
    """+3 confirmed, +2 a head count other than zero (local first), +1 a share other than zero, +2 archived, +1 a direct link."""
    c = lambda n: (fields or {}).get(n, F.col(e + n))
    on = lambda x, n: F.when(F.coalesce(x, F.lit(False)), n).otherwise(0)
    link = F.coalesce(c("source_link"), F.lit(""))
    return (
        on(c("status") == "confirmed", 3) + on(F.coalesce(c("jobs_cut_sg"), c("jobs_cut_global")) != 0, 2) + on(c("pct_workforce") != 0, 1)
        + on(link.contains("web.archive.org"), 2) + on((link != "") & ~link.contains("news.google.com"), 1)
    )
