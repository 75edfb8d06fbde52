"""Column helpers for text: explicit character classes that mean the same in every regular-expression dialect."""

from __future__ import annotations

import re
import warnings
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it, written out since dialects differ on ``\\s``. Fixed values.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same class, and all other characters, written so that the engine decides on most characters by one look.
_BLANK = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"
_INK = rf"(?:[!-~]|(?!{_BLANK})(?s:.))"
#: The characters of SPACE themselves.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Character classes of the text measures. Fixed values.
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}]"
ALNUM = r"[a-zA-Z0-9]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
COMMON_MARKS = r".,;:!?()\-\x{2014}\[\]{}<>\"'/\\@#$%^&*+=|~`"
GARBLED = r"[^\x{4E00}-\x{9FFF}\x{3000}-\x{303F}a-zA-Z0-9" + SPACE + COMMON_MARKS + r"]{15,}"
UNCOMMON = r"[^\x00-\x7F\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{2014}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{FF0C}\x{3002}\x{FF01}\x{FF1F}\x{FF1B}\x{FF1A}\x{FF08}\x{FF09}\x{3010}\x{3011}\x{300A}\x{300B}\x{3001}]"
FOREIGN = r"[^\x00-\x7F\x{4E00}-\x{9FFF}]"
#: Marks of text that was read in the wrong encoding: runs, single characters, and whole words. Fixed values.
MOJIBAKE = r"(?:[鐩綍绔鍏姝鏄鐨瀹鏂杩鎴搴閰瑙涓叧妯鍙鎶姟鍔卞彂]{2,}|[鈥聽銆€]{1,})"
MOJIBAKE_CHAR = r"[鐩綍绔鍏姝鏄鐨瀹鏂杩鎴搴閰瑙涓叧妯鍙鎶姟鍔卞彂绯荤粺]"
MOJIBAKE_TOKEN = "|".join((
    "姗欑毊", "鍏ラ棬", "绮鹃€", "娑电洊", "鏋舵瀯", "鍘熺悊", "閮ㄧ讲", "鏂规", "妗堛€", "娓犻亾", "鎺ュ叆", "绯荤粺", "妯″瀷", "閰嶇疆", "瀹夊叏", "鎴愭湰", "鍙傝€", "鎵嬪唽", "淇℃伅", "鏉ユ簮", "瀹樻柟",
    "鏂囨。", "浠撳簱", "绀惧尯", "璋冪爺", "鐗堟湰", "閫傜敤", "鍙戝竷", "鏃堕棿", "鐢熸€", "鍏ㄦ櫙", "鍏\ue0ff紬", "鐭ヨ瘑", "缂栫▼", "杈呭姪", "鍑嗙‘", "娆㈣繋", "鍏虫敞", "鍙嶉\ue69c", "棣堜氦", "閰嶅\ue576", "瑙嗛",
))
#: A name that scanning confuses, in the contexts that tell it. Fixed value.
OCR_CONFUSION = r"\b(?:All in Al|Al编程|Al工具|A时代|Al使用|Google Al)\b"
#: Lines that number a step. Fixed values.
NUMBERED = r"(?m)^[ \t]*(?:\d+[.、)][ \t]+|第?[一二三四五六七八九十百千\d]+步[骤]?[：:、. \t]|步骤[ \t]*[一二三四五六七八九十百千\d]+[：:、. \t])"
ENGLISH_STEP = r"(?mi)^[ \t]*step[ \t]*\d+[：:.) \t-]+"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
STEP = r"(\d+[.)\x{3001}][" + SPACE + r"]+|[sS][tT][eE][pP][" + SPACE + r"]*\d+[\x{FF1A}:.)\-" + SPACE + r"]+)"
FENCE = "`" * 3


def rx(pattern: str) -> Column:
    return F.lit(pattern)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def after(look: Column, test: Column) -> Column:
    """``look & test``, whose test costs nothing where the look is false. Before it comes to an ``and`` the engine makes what the expressions right of it repeat, for every row."""
    return F.when(~look, F.lit(False)).otherwise(test)


def at_most(c: Column, n: int) -> Column:
    """Whether a text has at most n characters besides white space; reads no further than that."""
    return (F.length(c) <= n) | c.rlike(rf"^{_BLANK}*+(?:{_INK}{_BLANK}*+){{0,{n}}}+\z")


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, whatever reads them: they come out of a generator, into which no filter and no later expression is merged."""
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, rx(pattern)).cast("long")


def matched_chars(c: Column, pattern: str) -> Column:
    """Characters in all matches together."""
    return F.length(F.array_join(F.regexp_extract_all(c, rx(pattern), 0), "")).cast("long")


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(0.0)


def any_term(c: Column, terms: list[str], low: Column | None = None) -> Column:
    """Whether the lower-case text holds one of the lower-case terms."""
    return _holds(c, tuple(t.lower() for t in terms), low) if terms else F.lit(False)


def any_pattern(c: Column, patterns: list[str], low: Column | None = None) -> Column:
    """Whether one of the patterns is found, in either case. The patterns stay as they are: lower case would turn ``\\S`` round."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | found(c, anycase(pattern), low)
    return hit


def found(c: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether the pattern is found, like ``rlike``. Where every match must hold one of some literals, texts without them are not searched.

    ``low``: the text in lower case, where it is at hand."""
    literals = needed(pattern)
    return _holds(c, literals, low) & c.rlike(pattern) if literals else c.rlike(pattern)


def _holds(c: Column, literals: tuple[str, ...], low: Column | None = None) -> Column:
    """Whether the text in lower case, made once, holds one of the literals."""
    def some(low: Column) -> Column:
        hit = F.contains(low, F.lit(literals[0]))
        for x in literals[1:]:
            hit = hit | F.contains(low, F.lit(x))
        return hit

    return F.exists(F.array(F.lower(c)), some) if low is None else some(low)


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Literals in lower case, one of which stands in the lower-case form of every text that the pattern matches; empty if none can be told.

    Only characters count that no other character than their own capital is equal to in either case (so not s, k, i);
    what Python does not read as the engine does gives none."""
    classes = re.findall(r"\[((?:\\.|[^\]\\])*)\]", re.sub(r"\\[^\[\]]", "", pattern))  # of a nested one, the outer up to the inner's end
    if "\\0" in pattern or "\\Q" in pattern or re.search(r"\(\?[a-zA-Z]*x|\[\^?\]", pattern) or any("[" in x.replace("\\[", "") or "&&" in x for x in classes):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _needed(re._parser.parse(pattern)) or ()
    except (re.error, Warning, OverflowError):
        return ()


def _needed(parsed) -> tuple[str, ...] | None:
    options: list[tuple[str, ...]] = []
    run = ""
    for op, of in parsed:
        name = str(op)
        low = chr(of).lower() if name == "LITERAL" else ""
        if low and ("!" <= low <= "~" and low not in "ski" or low == " " or "\u4e00" <= low <= "\u9fff"):
            run += low
            continue
        if name == "AT":
            continue
        options, run = [*options, (run,)], ""
        inner = of[-1] if name == "SUBPATTERN" else of[2] if name.endswith("REPEAT") and of[0] > 0 else of if name == "ATOMIC_GROUP" else None
        if inner is not None:
            options.append(_needed(inner) or ())
        elif name == "BRANCH":
            each = [_needed(x) for x in of[1]]
            options.append(tuple(dict.fromkeys(x for e in each for x in e)) if all(each) else ())
    worth = lambda o: min((len(x) + 2 * (x != "" and not x.isalnum()) for x in o), default=0)
    best = max([*options, (run,)], key=lambda o: (worth(o), -len(o)))
    return best if worth(best) >= 2 else None


def anycase(pattern: str) -> str:
    """The pattern, found in either case in any alphabet."""
    return f"(?iu){pattern}"


def rewrite(c: Column, pattern: str, change) -> Column:
    """The text with every match of the pattern replaced by ``change(match)``, a Column of it."""
    between, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, rx(pattern), 0)
    mixed = lambda h: F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.when(i < F.size(h), change(F.get(h, i))), F.lit("")))), "")
    return F.when(found(c, pattern), F.get(F.transform(F.array(hits), mixed), 0)).otherwise(c)  # the matches are made once, not for each of them


def _quoted(term: str) -> str:
    return "".join("\\" + x if x in r"\.^$|?*+()[]{}-" else x for x in term)
