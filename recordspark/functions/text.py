"""Text functions: built-in expressions throughout, Arrow UDFs only for Unicode folding and Jaro–Winkler similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Letters that canonical decomposition leaves whole, with their usual spelling.
WHOLE_LETTERS = {"ø": "o", "Ø": "O", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th", "ð": "d"}
_WHOLE = str.maketrans(WHOLE_LETTERS)


def _fold_one(s: str | None, table: dict | None) -> str | None:
    if not s:
        return None
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.translate(table) if table else s).encode("ascii", "ignore").decode()
    return s.lower().strip() or None


def fold(c: Column) -> Column:
    """Compatibility decomposition, non-ASCII letters dropped, lower case, trimmed; null for null and blank."""
    return F.pandas_udf(lambda s: s.map(lambda x: _fold_one(x, None), na_action="ignore").astype(object).where(lambda x: x.notna(), None), StringType())(c)


def spell_plain(c: Column) -> Column:
    """Like fold, but letters such as ø and ß get their usual plain spelling first."""
    return F.pandas_udf(lambda s: s.map(lambda x: _fold_one(x, _WHOLE), na_action="ignore").astype(object).where(lambda x: x.notna(), None), StringType())(c)


def initcap_alnum(c: Column) -> Column:
    """Every run of letters and digits gets an upper first letter and lower others; null stays null."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def phone10(c: Column) -> Column:
    """The last ten digits; null without digits."""
    return F.nullif(F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10)), F.lit(""))


def zip5(c: Column) -> Column:
    return F.nullif(F.left(c, F.lit(5)), F.lit(""))


def last_token(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"(?s)^.*\s", "")


def parsed_first_name(c: Column) -> Column:
    """First name out of `First Last`, `First M. Last` and `LAST, FIRST`."""
    return initcap_alnum(F.when(F.contains(c, F.lit(",")), F.trim(F.split_part(c, F.lit(","), F.lit(2)))).otherwise(F.split_part(F.trim(c), F.lit(" "), F.lit(1))))


def parsed_last_name(c: Column) -> Column:
    return initcap_alnum(F.when(F.contains(c, F.lit(",")), F.trim(F.split_part(c, F.lit(","), F.lit(1)))).otherwise(last_token(c)))


def person_id(ref: Column) -> Column:
    return F.concat(F.lit("FAN-"), F.substring(F.sha1(ref), 1, 12))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(hits, other)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_one(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro–Winkler similarity with the prefix boost only beyond a Jaro similarity of 0.7; null if either is null."""
    return F.pandas_udf(lambda x, y: pd.Series([jaro_winkler_one(p, q) for p, q in zip(x, y)], dtype="float64"), DoubleType())(a, b)


# Common English short forms of first names and the formal name that each stands for, compiled for this library.
SHORT_FORMS = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "angie": "angela", "archie": "archibald", "art": "arthur", "barney": "bernard", "becky": "rebecca",
    "ben": "benjamin", "bernie": "bernard", "bert": "albert", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william",
    "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david",
    "debbie": "deborah", "dick": "richard", "don": "donald", "doug": "douglas", "ed": "edward", "eddie": "edward", "ellie": "eleanor", "fran": "frances", "frank": "francis",
    "fred": "frederick", "gabe": "gabriel", "gene": "eugene", "gerry": "gerald", "greg": "gregory", "gus": "augustus", "hank": "henry", "harry": "harold", "jack": "john",
    "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jess": "jessica", "jim": "james", "jimmy": "james", "joe": "joseph",
    "johnny": "john", "jon": "jonathan", "josh": "joshua", "judy": "judith", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kenny": "kenneth",
    "kim": "kimberly", "larry": "lawrence", "lenny": "leonard", "leo": "leonard", "libby": "elizabeth", "liz": "elizabeth", "lou": "louis", "maggie": "margaret", "mandy": "amanda",
    "marge": "margaret", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mickey": "michael", "mike": "michael", "millie": "mildred", "molly": "mary",
    "nate": "nathaniel", "ned": "edward", "nell": "helen", "nick": "nicholas", "nikki": "nicole", "pam": "pamela", "pat": "patricia", "patty": "patricia", "peggy": "margaret",
    "penny": "penelope", "pete": "peter", "phil": "philip", "polly": "mary", "randy": "randolph", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert",
    "robbie": "robert", "ron": "ronald", "ronnie": "ronald", "russ": "russell", "sally": "sarah", "sam": "samuel", "sandy": "sandra", "steve": "steven", "stu": "stuart",
    "sue": "susan", "susie": "susan", "tammy": "tamara", "ted": "theodore", "terry": "terence", "theo": "theodore", "tim": "timothy", "timmy": "timothy", "tina": "christina",
    "tom": "thomas", "tommy": "thomas", "tony": "anthony", "trish": "patricia", "val": "valerie", "vicky": "victoria", "vince": "vincent", "walt": "walter", "wes": "wesley",
    "will": "william", "zach": "zachary",
}


def canonical_first_name(folded: Column) -> Column:
    """The formal name of a folded first name, itself where it is no short form."""
    pairs = [F.lit(x) for kv in SHORT_FORMS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), folded), folded)
