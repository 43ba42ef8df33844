"""Column expressions over text.  Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import COMMON_ENGLISH, ENGLISH_OPENINGS, SEPARATOR, SPACE, STOPWORDS, TITLES, WORD


def once(df, **columns: Column):
    """``df`` with columns that are computed once a row, however often later expressions and filters name them."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__once")
    return df.select("*", made).select(*df.columns, *[F.col(f"__once.{k}").alias(k) for k in columns])


def collapse(x: Column) -> Column:
    """White-space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def strip(x: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(x, rf"\A{SPACE}+|{SPACE}+\z", "")


def has_text(x: Column) -> Column:
    """Whether anything but white space is there."""
    return x.rlike(f"[^{SPACE[1:-1]}]")


def fragment_text(parts: Column) -> Column:
    """Parts joined by the separator, each with inner white space collapsed and one space at most at its ends."""
    one = lambda p: F.regexp_replace(p, f"{SPACE}+", " ")
    return F.array_join(F.transform(parts, one), SEPARATOR)


def edge_space(original: Column, translated: Column) -> Column:
    """``translated`` with a space at an edge where ``original`` has white space and it has none (F2, P14: empty stays)."""
    head = F.when(original.rlike(f"^{SPACE}") & ~translated.rlike(f"^{SPACE}"), " ").otherwise("")
    tail = F.when(original.rlike(f"{SPACE}$") & ~translated.rlike(f"{SPACE}$"), " ").otherwise("")
    return F.when((translated == "") | (original == ""), translated).otherwise(F.concat(head, translated, tail))


def inline_bilingual(original: Column, translated: Column) -> Column:
    """Both texts on one line."""
    return F.concat_ws(" | ", original, translated)


def tokens(x: Column) -> Column:
    """Token estimate of a text: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(x) / F.lit(4.0))).cast("int")


def word_tokens(x: Column) -> Column:
    """Words parted by white space, one at least: another measure of a chunk."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(x, f"{SPACE}+"), lambda w: w != ""))).cast("int")


def tokenizer_tokens(path: str):
    """A measure by a vocabulary file of the tokenizers library (F6, X5), one token at least, Arrow batches at a time."""
    held = {}

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        if path not in held:
            from tokenizers import Tokenizer

            held[path] = Tokenizer.from_file(path)
        found = held[path].encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([max(1, len(e.ids)) for e in found])

    return count


def separators(x: Column) -> Column:
    """Separators in a text."""
    return ((F.char_length(x) - F.char_length(F.replace(x, F.lit(SEPARATOR), F.lit("")))) / len(SEPARATOR)).cast("int")


def quote_pairs(x: Column, quotes: str = "“”«»") -> Column:
    """Pairs of typographic quotation marks, odd ones dropped (F7); straight quotes count only if ``quotes`` has them."""
    return F.floor((F.char_length(x) - F.char_length(F.translate(x, quotes, ""))) / 2).cast("int")


def word_runs(x: Column) -> Column:
    return F.filter(F.split(x, f"[^{WORD}]+"), lambda w: w != "")


def english_words(x: Column) -> Column:
    """(n, common): words of Latin letters without accents, and those among them that are common in English."""
    words = F.regexp_extract_all(F.lower(x), F.lit(f"(?<![{WORD}])[a-z]+(?![{WORD}])"), F.lit(0))
    return F.aggregate(
        words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("common")),
        lambda acc, w: F.struct((acc["n"] + 1).alias("n"), (acc["common"] + F.when(w.isin(sorted(set(COMMON_ENGLISH))), 1).otherwise(0)).alias("common")),
    )


def english_openings(x: Column) -> Column:
    """How many kinds of typical English openings a text has."""
    low = F.lower(x)
    opened = [F.when(low.rlike(f"(^|[^{WORD}])({alt}){SPACE}" + (f"+[{WORD}]" if word else "")), 1).otherwise(0) for alt, word in ENGLISH_OPENINGS]
    return sum(opened[1:], opened[0])


def english_sum(n: Column, common: Column, opened: Column) -> Column:
    """The score from its three parts: shares of common words and of openings, and a length bonus."""
    score = F.lit(0.6) * (common.cast("double") / n) + F.lit(0.3) * (opened.cast("double") / F.lit(5.0)) + F.least(n.cast("double") / F.lit(10.0), F.lit(0.2))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def english_score(x: Column) -> Column:
    """Likelihood that a text is English (M1)."""
    words = english_words(x)
    return english_sum(words["n"], words["common"], english_openings(x))


def sentences(x: Column) -> Column:
    """Sentences of a text, blank ones dropped."""
    return F.filter(F.split(x, f"[.!?]+{SPACE}+"), has_text)


def comparison_key(x: Column) -> Column:
    """Lower case, without punctuation, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(x), f"[^{WORD}{SPACE[1:-1]}]", ""))


def similarity(a: Column, b: Column) -> Column:
    """Equal characters at the same place, over the longer length (M2)."""
    most = F.greatest(F.char_length(a), F.char_length(b))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.isNotNull() & y.isNotNull() & (x == y) & (x != "")), lambda t: t))
    return F.when(most == 0, F.lit(1.0)).otherwise(same.cast("double") / most)


def cache_key(x: Column) -> Column:
    """File name that holds a source's translations."""
    clean = F.translate(F.translate(x, "\\/", "__"), ":", "")
    return F.concat(clean, F.lit("_"), F.substring(F.md5(x.cast("binary")), 1, 8), F.lit(".json"))


def is_upper_first(x: Column) -> Column:
    return x.rlike(r"^\p{Lu}")


def is_stopword(x: Column) -> Column:
    """P8."""
    return F.lower(x).isin(sorted(set(STOPWORDS)))


def is_excluded(x: Column) -> Column:
    """Words that a glossary never learns: stopwords, single characters, two characters in lower case."""
    return is_stopword(x) | (F.char_length(x) <= 1) | ((F.char_length(x) == 2) & x.rlike(r"^\p{Ll}"))


def is_extraction_error(source: Column, target: Column) -> Column:
    """A stopword taken for a name, or lengths more than five times apart (P10); an empty target is an error."""
    a, b = F.char_length(source).cast("double"), F.char_length(target).cast("double")
    apart = (a > 0) & (b > 0) & (F.greatest(a, b) / F.least(a, b) > 5)
    return (target == "") | (is_stopword(source) & is_upper_first(target)) | apart


def terms(x: Column) -> Column:
    """Sorted distinct terms of a text: capitalised words but for a first word alone, acronyms, CamelCase."""
    raw = F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "")
    # the next word comes by a shifted copy: looking it up in the lambda would split the text again for each word
    following = F.zip_with(raw, F.slice(F.concat(raw, F.array(F.lit(""))), 2, F.size(raw) + 1), lambda w, n: F.struct(w.alias("w"), n.alias("next")))
    spelt = F.transform(following, lambda s, i: F.struct(F.regexp_replace(s["w"], f"[^{WORD}]", "").alias("w"), i.alias("i"), s["next"].alias("next")))
    good = F.filter(spelt, lambda s: (F.char_length(s["w"]) >= 2) & ~s["w"].isin(TITLES) & is_upper_first(s["w"]) & ((s["i"] > 0) | is_upper_first(s["next"])))
    runs = word_runs(x)
    acronyms = F.filter(runs, lambda w: w.rlike("^[A-Z]{2,}$"))
    camel = F.filter(runs, lambda w: w.rlike("^[A-Z][a-z]+[A-Z][a-zA-Z]*$"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(good, lambda s: s["w"]), acronyms, camel)))


#: White space for Python, and what only Python takes for it.
GAPS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_GAP, _NO_GAP = re.compile(f"[{GAPS}]+"), re.compile("[\x1c-\x1f]")
_NO_WORD = re.compile(r"\W+")
_ACRONYM, _CAMEL = re.compile("[A-Z]{2,}"), re.compile("[A-Z][a-z]+[A-Z][a-zA-Z]*")


def _is_upper(x: str) -> bool:
    return x != "" and unicodedata.category(x[0]) == "Lu"


@lru_cache(1 << 17)
def _word_terms(w: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Terms in a word of a text: where it may be the word itself, and where it may not."""
    if w.isalpha():
        bare, parts = w, [w]
    else:
        bare, parts = _NO_WORD.sub("", w), _NO_WORD.split(w)
    runs = tuple(r for r in parts if _ACRONYM.fullmatch(r) or _CAMEL.fullmatch(r))
    return ((bare, *runs) if len(bare) >= 2 and bare not in TITLES and _is_upper(bare) else runs), runs


def _is_acronym(w: str) -> bool:
    return w.isupper() and w.isalpha() and w.isascii() and len(w) >= 2


@lru_cache(1 << 17)
def _later_terms(w: str) -> tuple[str, ...]:
    inner = w.strip(".,;:!?$%&*#()'\"")
    return (inner,) if _is_acronym(inner) else _word_terms(w)[0]


def term_words(text: str) -> list[str]:
    """``terms`` of one text in Python: a word is taken apart once, however often it comes; one in lower case holds none."""
    words = [w for w in _GAP.split(text) if w] if _NO_GAP.search(text) else text.split()
    if not words:
        return []
    later = [w for w in set(words[1:]) if not w.islower()]
    found = {w for w in later if w.isupper() and w.isalpha() and w.isascii() and len(w) >= 2}
    found.update(chain.from_iterable([_later_terms(w) for w in later if w not in found]))
    found.update(_word_terms(words[0])[len(words) == 1 or not _is_upper(words[1])])
    return sorted(found)


def proper_nouns(x: Column) -> Column:
    """Capitalised sequences and acronyms that do not open a sentence, line or text, in order."""
    from .words import NOT_NOUNS

    found = F.regexp_extract_all(x, F.lit(rf"(?<!\.{SPACE})(?<!\n)(?<!\A)(?<![{WORD}])([A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+)*|[A-Z]{{2,}})(?![{WORD}])"), F.lit(1))
    return F.filter(found, lambda w: ~F.lower(w).isin(NOT_NOUNS))
