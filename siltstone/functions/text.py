"""Column functions over paths, titles, ids, URLs and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "vault"
#: Query keys that only track visitors. Fixed values.
TRACKING_KEY = r"utm_[^=&]*|fbclid|gclid|mc_[^=&]*|_hsenc|_hsmi|ref|ref_[^=&]*"
#: What a page says when its text is behind a wall. Fixed values.
PAYWALL = r"(?i)\b(?:subscribe to read|paywall|sign up to continue|members only)\b"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def docid(hash_: Column) -> Column:
    """The short id of a text: six hex digits."""
    return F.substring(hash_, 1, 6)


def normalise_docid(name: Column) -> Column:
    """What a user may type for a short id: quotes, spaces and a leading # go."""
    return F.regexp_replace(F.trim(name), r"^[\"']?#?|[\"']$", "")


def is_docid(name: Column) -> Column:
    return normalise_docid(name).rlike(r"^(?i)[0-9a-f]{6,}$")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def title(text: Column, path: Column) -> Column:
    """First heading of a Markdown or Org file (a heading "Notes" gives way to the next one), else the file's stem."""
    found = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    first = found(r"(?m)^##?\s+(.+)$")
    markdown = F.when(first.isin("Notes", "\U0001f4dd Notes"), F.coalesce(found(r"(?m)^##\s+(.+)$"), first)).otherwise(first)
    org = F.coalesce(found(r"(?im)^#\+TITLE:\s*(.+)$"), found(r"(?m)^\*+\s+(.+)$"))
    low = F.lower(path)
    by_kind = F.when(low.endswith(".md"), markdown).when(low.endswith(".org"), org)
    return F.coalesce(by_kind, file_stem(path))


def clean_path(path: Column) -> Column:
    """A path made of letters, digits and $ in dash-joined words; three underscores part folders, symbols become their code points in hex, and the extension stays. Null where nothing is left of the name."""

    def coded(segment: Column) -> Column:
        # symbols become their code points, those in a row joined by dashes
        chars = F.split(segment, "")
        hexed = lambda c: F.lower(F.hex(F.ascii(c)))
        symbol = lambda c: c.rlike(r"[\p{So}\p{Sk}]")
        out = F.transform(chars, lambda c, i: F.when(symbol(c), F.concat(F.when(symbol(F.coalesce(F.get(chars, i - 1), F.lit(""))), "-").otherwise(""), hexed(c))).otherwise(c))
        return F.when(segment.rlike(r"[\p{So}\p{Sk}]"), F.array_join(out, "")).otherwise(segment)

    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}$]+", "-"), r"^-+|-+$", "")
    parts = F.transform(F.split(F.replace(path, F.lit("___"), F.lit("/")), "/"), coded)
    extension = lambda s: F.regexp_extract(s, r"(\.[A-Za-z0-9]+)$", 1)
    last = F.element_at(parts, -1)
    name = F.concat(tidy(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "")), extension(last))
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), tidy)
    joined = F.array_join(F.filter(F.concat(folders, F.array(name)), lambda s: s != ""), "/")
    usable = file_stem(path).rlike(r"[\p{L}\p{N}\p{So}\p{Sk}$]")
    return F.when(usable & (joined != ""), joined)


def virtual_path(collection: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), collection, F.lit("/"), path)


def split_virtual(name: str) -> tuple[str, str]:
    """(collection, path) of what virtual_path made."""
    collection, _, path = name.removeprefix(f"{SCHEME}://").partition("/")
    return collection, path


def normalise_virtual(name: Column) -> Column:
    """One spelling of a virtual path: the scheme with any number of slashes, or just leading double slashes; other names stay."""
    s = F.trim(name)
    tail = F.regexp_replace(F.regexp_replace(s, f"^{SCHEME}:", ""), "^/+", "")
    return F.when(s.startswith(f"{SCHEME}:") | s.startswith("//"), F.concat(F.lit(f"{SCHEME}://"), tail)).otherwise(s)


def parse_virtual(name: Column) -> Column:
    """struct<collection, path, index> of a virtual path, null for other names."""
    s = normalise_virtual(name)
    bare, query = F.substring_index(s, "?", 1), F.when(s.contains("?"), F.regexp_extract(s, r"[?&]index=([^&]*)", 1))
    pattern = rf"^{SCHEME}://([^/]+)/?(.*)$"
    got = F.struct(F.regexp_extract(bare, pattern, 1).alias("collection"), F.regexp_extract(bare, pattern, 2).alias("path"), F.nullif(F.trim(F.url_decode(query)), F.lit("")).alias("index"))
    return F.when(bare.rlike(pattern), got)


def line_slice(body: Column, first: int = 1, count: int | None = None) -> Column:
    """Lines first .. first+count-1 of body, counted from 1."""
    lines = F.split(body, "\n", -1)
    first = max(1, first)
    return F.array_join(F.slice(lines, first, count if count is not None else 1 << 30), "\n")


def numbered(text: Column, first: int = 1) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def slug(name: Column) -> Column:
    """Lower case, only letters, digits, spaces and dashes; spaces and dashes in a row become one dash."""
    s = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"[\s-]+", "-"), r"^-|-$", "")


def canonical_url(url: Column) -> Column:
    """Lower-case host, no fragment, no tracking keys, and no slash after a bare host."""
    s = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme, rest = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, after = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), F.regexp_replace(rest, r"^[^/?]*", "")
    path, query = F.substring_index(after, "?", 1), F.when(after.contains("?"), F.regexp_replace(after, r"^[^?]*\?", ""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i)(?:{TRACKING_KEY})(?:=|$)")), "&")
    tail = F.when(F.coalesce(kept, F.lit("")) != "", F.concat(F.lit("?"), kept)).otherwise("")
    path = F.when(path.isin("", "/"), F.when(tail == "", "").otherwise("/")).otherwise(path)
    return F.concat(scheme, F.lit("://"), host, path, tail)


def source_id(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 12)


def body_hash(body: Column) -> Column:
    """Hash of a text regardless of its white space."""
    return F.sha2(F.trim(F.regexp_replace(body, r"\s+", " ")), 256)


def language_guess(text: Column) -> Column:
    """ko or en by the letters of the first 1000 characters, else null."""
    head = F.substring(text, 1, 1000)
    cjk, latin = F.regexp_count(head, F.lit(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")), F.regexp_count(head, F.lit("[A-Za-z]"))
    return F.when(cjk > 2 * latin, "ko").when((latin > 5) & (cjk == 0), "en").when(cjk > 0, "ko")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def quality_verdict(body: Column, url: Column, language: Column, min_words: int = 200, max_words: int = 50_000, excluded: list[str] | None = None, languages: list[str] | None = None) -> Column:
    """ok, or the first rule that a page breaks."""
    n, host = word_count(body), F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    banned = F.lit(False)
    for d in excluded or []:
        banned = banned | (host == d.lower()) | host.endswith("." + d.lower())
    foreign = language.isNotNull() & ~language.isin(languages) if languages else F.lit(False)
    walled = F.substring(body, 1, 2000).rlike(PAYWALL)
    return F.when(n < min_words, "too_short").when(n > max_words, "too_long").when(banned, "excluded_domain").when(foreign, "language").when(walled, "paywall").otherwise("ok")
