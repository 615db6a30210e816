"""From text to index terms, and from a query string to clauses."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Terms whose stems a task remembers at a time.
MEMO = 200_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spaced(text: Column) -> Column:
    """tokens as one text, with a space between them: lists of short strings are slow to hand to Python."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


HANGUL = r"[\uac00-\ud7af\u1100-\u11ff\u3130-\u318f]"


def stemmed(terms: Column) -> Column:
    """An array of terms, folded and stemmed: an Arrow batch at a time, each term once a task as long as the memo lasts."""
    return analysed(terms, None, True)


def analysed(terms: Column, korean=None, stems: bool = True) -> Column:
    """An array of terms, each given to the analyser of its script, in its place: runs of Hangul to an injected one, which gives the words that carry meaning; all terms then folded and stemmed."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[str]] = {}  # over a task's batches

        def one(term: str) -> list[str]:
            if term not in known:
                if len(known) >= MEMO:
                    known.clear()
                words = [w.lower() for w in korean(term)] if korean is not None and re.match(HANGUL, term) else [term]
                known[term] = [stem(w) for w in words] if stems else words
            return known[term]

        for lists in batches:
            # each term of a batch once; the others are its copies
            terms_ = lists.flatten().dictionary_encode()
            words = [one(t) for t in terms_.dictionary.to_pylist()]
            if all(len(w) == 1 for w in words):
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.ListArray.from_arrays(offsets, pa.array([w[0] for w in words], pa.string()).take(terms_.indices), mask=lists.is_null())
            else:
                yield pa.array([None if x is None else [w for t in x for w in one(t)] for x in lists.to_pylist()], pa.list_(pa.string()))

    return run(terms)


def script_tokens(text: Column) -> Column:
    """tokens, cut where the script changes between Hangul and others: within the row, nothing is shuffled."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{HANGUL}+|(?:(?!{HANGUL})[\\p{{L}}\\p{{N}}])+"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def places(terms: Column) -> Column:
    """array<struct<term, positions>> of an array of terms: each term once, with its places in order."""

    def grouped(s: Column) -> Column:
        def runs(heads: Column) -> Column:
            def run(at: Column, k: Column) -> Column:
                end = F.coalesce(F.get(heads, k + 1), F.size(s))
                return F.struct(F.get(s, at)["term"].alias("term"), F.transform(F.slice(s, at + 1, end - at), lambda x: x["pos"]).alias("positions"))

            return F.transform(heads, run)

        return let(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"])), runs)

    none = F.array().cast("array<struct<term:string,positions:array<int>>>")
    ordered = F.array_sort(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    return F.when(F.size(terms) > 0, let(ordered, grouped)).otherwise(none)


def python_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def fold(term: str) -> str:
    """Without diacritics."""
    if term.isascii():
        return term
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", term) if not unicodedata.combining(c)))


#: Vowels and other characters of a word without y.
LETTERS = {c: "v" if chr(c) in "aeiou" else "c" for c in range(128)}


class Porter:
    """The Porter stemmer (M. F. Porter, 1980), for lower-case words."""

    RULES2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    RULES3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    RULES4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]

    @staticmethod
    def shape(w: str) -> str:
        if "y" not in w:
            return w.translate(LETTERS)
        out = ""
        for i, c in enumerate(w):
            vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    @classmethod
    def measure(cls, w: str) -> int:
        return cls.shape(w).count("vc")

    @classmethod
    def cvc(cls, w: str) -> bool:
        return cls.shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    @classmethod
    def _replace(cls, w: str, rules: dict[str, str]) -> str:
        if not w.endswith(tuple(rules)):
            return w
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                return w[: -len(end)] + rules[end] if cls.measure(w[: -len(end)]) > 0 else w
        return w

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) <= 2 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if cls.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and "v" in cls.shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and cls.shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif cls.measure(w) == 1 and cls.cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in cls.shape(w[:-1]):
            w = w[:-1] + "i"
        w = cls._replace(cls._replace(w, cls.RULES2), cls.RULES3)
        for end in cls.RULES4 if w.endswith(tuple(cls.RULES4)) else ():
            if w.endswith(end):
                head = w[: -len(end)]
                if cls.measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                    w = head
                break
        if w.endswith("e") and (cls.measure(w[:-1]) > 1 or (cls.measure(w[:-1]) == 1 and not cls.cvc(w[:-1]))):
            w = w[:-1]
        if w.endswith("ll") and cls.measure(w) > 1:
            w = w[:-1]
        return w


def stem(term: str) -> str:
    return Porter.stem(fold(term))


@dataclass(frozen=True)
class Clause:
    """Adjacent terms; the last one may be a prefix; a negated clause rules documents out."""

    terms: tuple[str, ...]
    prefix: bool = False
    negated: bool = False


_PART = re.compile(r'(?P<no>-?)(?:"(?P<phrase>[^"]*)(?:"|$)|(?P<term>[^\s"]+))')
_HYPHENED = re.compile(r"^[^\W_]+(?:-[^\W_]+)+$")


def parse_query(text: str, analyse=lambda t: t, split=python_tokens) -> list[Clause]:
    """Clauses of a query: words match as prefixes, quoted text and hyphened words as phrases, and a dash before either negates it. split is what makes terms of a text, as it was done to the index; a word that gives several is a phrase with an open end.

    Without a positive clause there is nothing to search for, and the list is empty."""
    out = []
    for m in _PART.finditer(text.strip()):
        if m["phrase"] is not None:
            words = [re.sub(r"[^\w']|_", "", w) for w in m["phrase"].split()]
            terms, prefix = [t for w in words for t in split(w)], False
        elif _HYPHENED.match(m["term"]):
            terms, prefix = split(m["term"]), False
        else:
            terms, prefix = split(re.sub(r"[^\w']", "", m["term"])), True
        if terms:
            out.append(Clause(tuple(map(analyse, terms)), prefix, bool(m["no"])))
    return out if any(not c.negated for c in out) else []


@dataclass(frozen=True)
class TypedQuery:
    type: str
    text: str
    line: int = 0


class QueryError(ValueError):
    pass


def parse_document(text: str) -> tuple[list[TypedQuery], str | None] | None:
    """Typed lines (lex:, vec:, hyde:, intent:) of a structured query; None for a plain one, which is to be expanded."""
    lines = [(k + 1, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip()]
    typed, intent = [], None
    for number, line in lines:
        m = re.match(r"(?i)(lex|vec|hyde|intent|expand):\s*(.*)$", line)
        if m is None:
            if len(lines) > 1:
                raise QueryError(f"line {number} has no type")
            return None
        kind, rest = m[1].lower(), m[2].strip()
        if not rest:
            raise QueryError(f"line {number} has no text")
        if kind == "expand":
            if len(lines) > 1:
                raise QueryError("expand: stands alone")
            return None
        if kind == "intent":
            if intent is not None:
                raise QueryError("one intent: at most")
            intent = rest
        else:
            typed.append(TypedQuery(kind, rest, number))
    if intent is not None and not typed:
        raise QueryError("intent: needs a query")
    return (typed, intent) if typed else None


def validate(query: TypedQuery) -> str | None:
    """What is wrong with a typed query, if anything."""
    if "\n" in query.text or "\r" in query.text:
        return "a query is one line"
    if query.type == "lex" and query.text.count('"') % 2:
        return "unmatched quote"
    if query.type in ("vec", "hyde") and re.search(r'-\w|-"', query.text):
        return "negation is for lex queries"
    return None


#: Words of an intent that say nothing about its subject. Fixed values.
INTENT_STOP = frozenset(
    """am an as at be by do he if in is it me my no of on or so to up us we
    all and any are but can did for get has her him his how its let may not our out the too was who why you
    also does find from have into more need show some tell that them this want what when will with your
    about looking notes search where which""".split()
)


def intent_terms(intent: str) -> list[str]:
    stripped = (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in intent.lower().split())
    return [w for w in stripped if len(w) > 1 and w not in INTENT_STOP]


def mixed_tokens(text: str, korean=None) -> list[str]:
    """Terms of a text in several scripts: runs of Hangul go to an injected analyser, which gives the words that carry meaning, and all else is split as usual. Without an analyser everything is."""
    if korean is None:
        return python_tokens(text)
    out = []
    for part in re.findall(f"{HANGUL}+|(?:(?!{HANGUL}).)+", text, re.S):
        out += [w.lower() for w in korean(part)] if re.match(HANGUL, part) else python_tokens(part)
    return out
