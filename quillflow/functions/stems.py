"""English stems as one column expression: the published Porter2 rules.

A word is carried through the steps with two places: R1 begins after the first consonant that follows a vowel, R2 likewise inside
R1. A suffix is taken off or replaced only where its place, or the sound before it, allows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# Fixed values of the published rules, in their order.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = "sky news howe atlas cosmos bias andes".split()
UNCHANGED_SINGULAR = "inning outing canning herring earring proceed exceed succeed".split()
REGION_PREFIXES = "gener commun arsen".split()
DERIVED = {  # step 2, in R1
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
SIMPLER = {  # step 3, in R1
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
PAST = "eed eedly ed edly ing ingly".split()
ENDINGS = (  # step 4, in R2
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion").split()

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = f"{OTHER}*{VOWEL}+{OTHER}"
# A short syllable at the end: vowel and consonant after a consonant, or at the word's beginning.
SHORT_END = f"(?:{OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _ends_in(word: Column, suffixes) -> Column:
    """Are the last two letters those of one of the suffixes? Far cheaper than a pattern, and settles most words."""
    return F.right(word, F.lit(2)).isin(sorted({s[-2:] for s in suffixes}))


def _ending(word: Column, suffixes) -> Column:
    """The longest of the suffixes that the word ends in, else an empty string."""
    return F.when(_ends_in(word, suffixes), F.regexp_extract(word, f"(?:{'|'.join(suffixes)})$", 0)).otherwise("")


def _before(word: Column, ending: Column) -> Column:
    return F.substring(word, F.lit(1), F.char_length(word) - F.char_length(ending))


def _region(word: Column, pattern: str) -> Column:
    """Letters before the region that the pattern's match opens; all of them where there is none."""
    found = F.char_length(F.regexp_extract(word, f"^(?:{pattern})", 0))
    return F.when(found == 0, F.char_length(word)).otherwise(found)


def _replaced(word: Column, ending: Column, table: dict[str, str]) -> Column:
    new = F.when(F.lit(False), "")
    for replacement in dict.fromkeys(table.values()):
        new = new.when(ending.isin([s for s, r in table.items() if r == replacement]), replacement)
    return F.concat(_before(word, ending), new)


def _singular(word: Column) -> Column:
    return (
        F.when(~(word.endswith("s") | word.endswith("ied")), word)
        .when(word.endswith("sses"), _before(word, F.lit("es")))
        .when(word.rlike("ie[ds]$"), F.when(F.char_length(word) > 4, _before(word, F.lit("es"))).otherwise(_before(word, F.lit("s"))))
        .when(word.rlike("[us]s$"), word)
        .when(word.rlike(f"{VOWEL}.+s$"), _before(word, F.lit("s")))
        .otherwise(word))


def _past(word: Column, r1: Column) -> Column:
    def ended(ending: Column) -> Column:
        stem = _before(word, ending)
        mended = (
            F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
            .when(stem.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _before(stem, F.lit("x")))
            .when((F.char_length(stem) <= r1) & stem.rlike(SHORT_END), F.concat(stem, F.lit("e")))
            .otherwise(stem))
        return (
            F.when(ending.isin("eed", "eedly"), F.when(F.char_length(stem) >= r1, F.concat(stem, F.lit("ee"))).otherwise(word))
            .when((ending != "") & stem.rlike(VOWEL), mended)
            .otherwise(word))

    return bind(_ending(word, PAST), ended)


def _final_y(word: Column) -> Column:
    y = word.endswith("y") | word.endswith("Y")
    return F.when(y & word.rlike(f"^.+{OTHER}[yY]$"), F.concat(_before(word, F.lit("y")), F.lit("i"))).otherwise(word)


def _derived(word: Column, r1: Column) -> Column:
    def ended(ending: Column) -> Column:
        stem = _before(word, ending)
        allowed = F.when(ending == "ogi", stem.endswith("l")).when(ending == "li", stem.rlike("[cdeghkmnrt]$")).otherwise(True)
        good = (ending != "") & (F.char_length(stem) >= r1) & allowed
        return F.when(good, _replaced(word, ending, DERIVED)).otherwise(word)

    return bind(_ending(word, DERIVED), ended)


def _simpler(word: Column, r1: Column, r2: Column) -> Column:
    def ended(ending: Column) -> Column:
        size = F.char_length(word) - F.char_length(ending)
        good = (ending != "") & (size >= r1) & ((ending != "ative") | (size >= r2))
        return F.when(good, _replaced(word, ending, SIMPLER)).otherwise(word)

    return bind(_ending(word, SIMPLER), ended)


def _without_ending(word: Column, r2: Column) -> Column:
    def ended(ending: Column) -> Column:
        stem = _before(word, ending)
        good = (ending != "") & (F.char_length(stem) >= r2) & ((ending != "ion") | stem.rlike("[st]$"))
        return F.when(good, stem).otherwise(word)

    return bind(_ending(word, ENDINGS), ended)


def _last(word: Column, r1: Column, r2: Column) -> Column:
    stem, size = _before(word, F.lit("e")), F.char_length(word) - 1
    loose = (size >= r2) | ((size >= r1) & ~stem.rlike(SHORT_END))
    return F.when(word.endswith("e") & loose, stem).when(word.endswith("ll") & (size >= r2), stem).otherwise(word)


def _may_change(word: Column) -> Column:
    """Can a step after the first one change the word? All others go through none of them."""
    return F.right(word, F.lit(1)).isin("e", "y", "Y") | _ends_in(word, ["ll", *PAST, *DERIVED, *SIMPLER, *ENDINGS])


def english(word: Column) -> Column:
    """Stem of a lower-case word; words of up to two letters stay, other alphabets' letters count as consonants."""
    def regions(w: Column, v: Column) -> Column:
        return bind(_region(w, "|".join([*REGION_PREFIXES, _REGION])), lambda r1: bind(
            r1 + _region(F.substr(w, r1 + 1), _REGION), lambda r2: steps(v, r1, r2)))

    def steps(v: Column, r1: Column, r2: Column) -> Column:
        ends = lambda b: bind(_derived(b, r1), lambda c: bind(_simpler(c, r1, r2), lambda d: _without_ending(d, r2)))
        shorter = lambda b: F.when(_ends_in(b, [*DERIVED, *SIMPLER, *ENDINGS]), ends(b)).otherwise(b)
        return bind(_past(v, r1), lambda a: bind(_final_y(a), lambda b: bind(shorter(b), lambda e: _last(e, r1, r2))))

    def whole(w: Column) -> Column:
        return bind(_singular(w), lambda v: F.when(
            v.isin(UNCHANGED_SINGULAR) | ~_may_change(v), v).otherwise(regions(w, v)))

    special = F.when(F.lit(False), "")
    for odd, stem in SPECIAL.items():
        special = special.when(word == odd, stem)
    marked = F.when(F.contains(word, F.lit("y")), F.regexp_replace(
        F.regexp_replace(word, "^y", "Y"), f"({VOWEL})y", "$1Y")).otherwise(word)
    stemmed = F.translate(bind(marked, whole), "Y", "y")
    may_change = word.endswith("s") | _may_change(word) | F.contains(word, F.lit("Y"))
    unchanged = (F.char_length(word) <= 2) | word.isin(UNCHANGED) | ~may_change
    return F.when(word.isin(list(SPECIAL)), special).when(unchanged, word).otherwise(stemmed)


_S = "|".join
# The same rules in SQL, over a view `vocabulary(word)`: every step is a column.
ENGLISH_SQL = rf"""
marked AS (SELECT word, CASE WHEN word[1] = 'y' THEN 'Y' || word[2:] ELSE word END AS w0 FROM vocabulary),
marked2 AS (SELECT word, regexp_replace(w0, '([aeiouy])y', '\1Y', 'g') AS w FROM marked),
one AS (SELECT *, CASE WHEN regexp_matches(w, '^({_S(REGION_PREFIXES)}|{_REGION})')
    THEN length(regexp_extract(w, '^({_S(REGION_PREFIXES)}|{_REGION})')) ELSE length(w) END AS r1 FROM marked2),
two AS (SELECT *, r1 + CASE WHEN regexp_matches(w[r1 + 1:], '^{_REGION}')
    THEN length(regexp_extract(w[r1 + 1:], '^{_REGION}')) ELSE length(w) - r1 END AS r2 FROM one),
s1 AS (SELECT *, CASE WHEN w LIKE '%sses' THEN w[:-3]
    WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN w[:-3] ELSE w[:-2] END
    WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN w[:-2] ELSE w END AS a FROM two),
e2 AS (SELECT *, regexp_extract(a, '(eedly|eed|edly|ed|ingly|ing)$') AS x FROM s1),
p2 AS (SELECT *, a[:length(a) - length(x)] AS p FROM e2),
s2 AS (SELECT *, CASE WHEN x IN ('eed', 'eedly') THEN CASE WHEN length(p) >= r1 THEN p || 'ee' ELSE a END
    WHEN x = '' OR NOT regexp_matches(p, '[aeiouy]') THEN a
    WHEN regexp_matches(p, '(at|bl|iz)$') THEN p || 'e'
    WHEN regexp_matches(p, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN p[:-2]
    WHEN length(p) <= r1 AND regexp_matches(p, '{SHORT_END}') THEN p || 'e' ELSE p END AS b FROM p2),
s3 AS (SELECT *, CASE WHEN regexp_matches(b, '^.+[^aeiouy][yY]$') THEN b[:-2] || 'i' ELSE b END AS c FROM s2),
e4 AS (SELECT *, regexp_extract(c, '({_S(DERIVED)})$') AS y FROM s3),
p4 AS (SELECT *, c[:length(c) - length(y)] AS q FROM e4),
s4 AS (SELECT *, CASE WHEN y = '' OR length(q) < r1 OR (y = 'ogi' AND q NOT LIKE '%l')
      OR (y = 'li' AND NOT regexp_matches(q, '[cdeghkmnrt]$')) THEN c
    ELSE q || CASE y {' '.join(f"WHEN '{s}' THEN '{r}'" for s, r in DERIVED.items())} END END AS d FROM p4),
e5 AS (SELECT *, regexp_extract(d, '({_S(SIMPLER)})$') AS z FROM s4),
s5 AS (SELECT *, CASE WHEN z = '' OR length(d) - length(z) < r1 OR (z = 'ative' AND length(d) - length(z) < r2) THEN d
    ELSE d[:length(d) - length(z)] || CASE z {' '.join(f"WHEN '{s}' THEN '{r}'" for s, r in SIMPLER.items())} END END AS e FROM e5),
e6 AS (SELECT *, regexp_extract(e, '({_S(ENDINGS)})$') AS v FROM s5),
s6 AS (SELECT *, CASE WHEN v = '' OR length(e) - length(v) < r2 OR (v = 'ion' AND NOT regexp_matches(e, '[st]ion$')) THEN e
    ELSE e[:length(e) - length(v)] END AS f FROM e6),
s7 AS (SELECT *, CASE WHEN f LIKE '%e' AND (length(f) > r2 OR (length(f) > r1 AND NOT regexp_matches(f[:-2], '{SHORT_END}')))
    THEN f[:-2] WHEN f LIKE '%ll' AND length(f) > r2 THEN f[:-2] ELSE f END AS g FROM s6),
stems AS (SELECT word, CASE {' '.join(f"WHEN word = '{w}' THEN '{s}'" for w, s in SPECIAL.items())}
    WHEN length(word) <= 2 OR word IN ({', '.join(f"'{w}'" for w in UNCHANGED)}) THEN word
    WHEN a IN ({', '.join(f"'{w}'" for w in UNCHANGED_SINGULAR)}) THEN replace(a, 'Y', 'y') ELSE replace(g, 'Y', 'y') END AS stem FROM s7)"""
