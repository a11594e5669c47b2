"""Text analysis for full-text search: split, drop long words, lower, stem, stop words, folding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words; fixed values.
STOP_WORDS = frozenset("""
a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can couldn couldn't d did didn didn't do does
doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven haven't having he he'd he'll he's her here hers herself him himself his
how i i'd i'll i'm i've if in into is isn isn't it it'd it'll it's its itself just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on
once only or other our ours ourselves out over own re s same shan shan't she she'd she'll she's should should've shouldn shouldn't so some such t than that that'll the their theirs
them themselves then there these they they'd they'll they're they've this those through to too under until up ve very was wasn wasn't we we'd we'll we're we've were weren weren't what
when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself yourselves
""".split())
#: Operators of more than one character that the code tokenizer keeps whole; fixed values.
OPERATORS = ">>>= <<= >>= &&= ||= ??= **= //= === !== >>> <=> :: -> => == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >> ** // ?? := <- |> ~=".split()
#: Letters that don't decompose, as ASCII; fixed values.
_LETTERS = str.maketrans({"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ı": "i", "ħ": "h", "Ħ": "H"})
_CEDILLAS = str.maketrans("ŞşŢţ", "ȘșȚț")
_ARABIC = str.maketrans({"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه"})
_SEMITIC_MARKS = re.compile("[֑-ׇֽֿׁׂׅׄؐ-ؚـً-ٰٟ]")
_SIMPLE = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_CODE = regex.compile(r"(?P<id>[\p{Alphabetic}\p{N}_]+)|(?P<op>" + "|".join(map(re.escape, sorted(OPERATORS, key=len, reverse=True))) + r"|[!%&*+\-/:<=>?^|~])")
_HUMPS = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
_PIECES = regex.compile("_+|" + _HUMPS)
_NUMERIC_PIECES = regex.compile("_+|" + _HUMPS + r"|(?<=[0-9])(?=[^0-9_])|(?<=[^0-9_])(?=[0-9])")


@dataclass(frozen=True)
class Params:
    base_tokenizer: str = "simple"  # simple, whitespace, raw, ngram, code
    language: str = "English"
    with_position: bool = False
    max_token_length: int | None = 40  # bytes; longer words and those of just this length go
    lower_case: bool = True
    stem: bool = True
    remove_stop_words: bool = True
    custom_stop_words: tuple[str, ...] | None = None
    ascii_folding: bool = True
    min_ngram_length: int = 3
    max_ngram_length: int = 3
    prefix_only: bool = False
    split_identifiers: bool = False
    split_on_numerics: bool = False
    preserve_original: bool = False
    index_operators: bool = False
    unicode_normalize: bool = False
    remove_marks: bool = False
    arabic_normalize: bool = False
    ascii_folding_keep_original: bool = False

    def __post_init__(self):
        if self.base_tokenizer not in ("simple", "whitespace", "raw", "ngram", "code"):
            raise ValueError(f"tokenizer {self.base_tokenizer!r} is not supported (models for it are external)")

    @property
    def native(self) -> bool:
        """Whether Spark's own functions do it: words, in lower case or as they are."""
        return self.base_tokenizer in ("simple", "whitespace", "raw") and not (
            self.stem or self.remove_stop_words or self.ascii_folding or self.unicode_normalize or self.remove_marks or self.arabic_normalize)


#: Words in lower case and nothing else.
PLAIN = Params(stem=False, remove_stop_words=False, ascii_folding=False)
#: What a column without an index is searched with.
RAW_WORDS = Params(lower_case=False, stem=False, remove_stop_words=False, ascii_folding=False, max_token_length=None)


def fold(word: str) -> str:
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word.translate(_LETTERS)) if not unicodedata.combining(c))


# -- English stemming, as the published Porter2 algorithm has it ----------------------------------------------

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPT = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
           "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EXCEPT_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
          ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
          ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", re.S)


def _regions(w: str) -> tuple[int, int]:
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            break
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _is_short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(_SHORT.match(w))


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w in _EXCEPT:
        return _EXCEPT[w]
    w = w.lstrip("'") if w.startswith("'") else w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].+$", w[:-1], re.S) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _EXCEPT_1A:
        return w
    if w.endswith(("eed", "eedly")):
        end = 3 if w.endswith("eed") else 5
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and any(c in _V for c in w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _is_short(w, r1):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix, to in _STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for suffix, to in _STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                w = w[:at] + to
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not _SHORT.match(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _words(text: str, p: Params) -> Iterator[tuple[str, int]]:
    if p.base_tokenizer == "raw":
        yield text, 0
    elif p.base_tokenizer == "ngram":
        for i in range(len(text)):
            if p.prefix_only and i:
                return
            for n in range(p.min_ngram_length, p.max_ngram_length + 1):
                if i + n <= len(text):
                    yield text[i : i + n], 0
    elif p.base_tokenizer == "code":
        at = 0
        for m in _CODE.finditer(text):
            if m.lastgroup == "op":
                if p.index_operators:
                    yield m.group(), at
                    at += 1
                continue
            parts = [x for x in (_NUMERIC_PIECES if p.split_on_numerics else _PIECES).split(m.group()) if x] if p.split_identifiers else []
            if len(parts) <= 1:
                yield m.group(), at
                at += 1
                continue
            if p.preserve_original:
                yield m.group(), at
            yield from ((x, at + k) for k, x in enumerate(parts))
            at += len(parts)
    else:
        found = _SIMPLE.findall(text) if p.base_tokenizer == "simple" else [w for w in re.split(r"[ \t\n\x0c\r]+", text) if w]
        yield from ((w, k) for k, w in enumerate(found))


def tokenize(text: str | None, p: Params = Params()) -> list[tuple[str, int]]:
    """(term, position) of a text; positions count words before any is dropped."""
    if text is None:
        return []
    if p.unicode_normalize or p.remove_marks or p.arabic_normalize:
        text = unicodedata.normalize("NFC", text)
        text = _SEMITIC_MARKS.sub("", text) if p.remove_marks else text
        text = text.translate(_CEDILLAS)
        text = text.translate(_ARABIC) if p.arabic_normalize else text
    filters = _filters(p)
    return [(t, at) for w, at in _words(text, p) for t in filters(w)]


@lru_cache(maxsize=16)
def _filters(p: Params):
    """What a word becomes: no term, one, or two; the answers for 200,000 words are kept."""
    stops = frozenset(p.custom_stop_words) if p.custom_stop_words is not None else STOP_WORDS

    @lru_cache(maxsize=200_000)
    def run(w: str) -> tuple[str, ...]:
        if p.max_token_length and len(w.encode()) >= p.max_token_length:
            return ()
        w = w.lower() if p.lower_case else w
        w = stem(w) if p.stem else w
        if p.remove_stop_words and w in stops:
            return ()
        folded = fold(w) if p.ascii_folding else w
        return (w, folded) if folded != w and p.ascii_folding_keep_original else (folded,)

    return run


def analyzed(texts: pa.Array, p: Params) -> pa.ListArray:
    """list<struct<t string, p int>> of texts, null of a null."""
    words, places, ends, known = [], [], [0], []
    for x in texts.to_pylist():
        found = tokenize(x, p)
        words += [t for t, _ in found]
        places += [k for _, k in found]
        ends.append(len(words))
        known.append(x is not None)
    flat = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int32())], names=["t", "p"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([not k for k in known], pa.bool_()))


def terms(text: Column, p: Params = Params()) -> Column:
    """array<struct<t string, p int>> of a text column: by Spark's own functions where the settings allow."""
    if p.native:
        low = F.lower(text) if p.lower_case else text
        if p.base_tokenizer == "raw":
            words = F.array(low)
        else:
            words = F.regexp_extract_all(low, F.lit(r"[\p{IsAlphabetic}\p{N}]+" if p.base_tokenizer == "simple" else r"[^ \t\n\x0C\r]+"), F.lit(0))
        made = F.transform(words, lambda w, i: F.struct(w.alias("t"), i.alias("p")))
        if p.max_token_length:
            made = F.filter(made, lambda x: F.octet_length(x["t"]) < p.max_token_length)
        return made

    @F.arrow_udf("array<struct<t: string, p: int>>")
    def analyze(texts: pa.Array) -> pa.Array:
        return analyzed(texts, p)

    return analyze(text)
