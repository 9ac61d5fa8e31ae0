"""Field candidates in free text: labelled patterns in English and Hindi, as array expressions.

One pass per pattern over the text, no join and no shuffle. A name match may be followed by an
address: everything up to the first six-digit PIN code within 220 characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, running, strip, upto
from .vocab import ADDRESS_OF

_S = r"[\s\p{Z}]*"
_SEP = rf"{_S}[:\-]?{_S}"
_MUST = rf"{_S}[:\-]{_S}"
_NAME = r"([^|\n\r,]{3,120})"
_LINE = r"([^|\n\r]{3,150})"
_DATE = r"([\p{L}\p{Nd}_/\-. ]{4,20})"
_AMOUNT = r"([\p{Nd},]+(?:\.\p{Nd}{1,2})?)"
_PHONE = r"(\+?\p{Nd}[\p{Nd}\-\s]{7,14}\p{Nd})"
_UNIT = "g|gm|gram|grams|kg|kgs|ml|l|lt|ltr|litre|liter"


def _words(*phrases: str) -> str:
    return "(?:" + "|".join(p.replace(" ", _S) for p in phrases) + ")"


#: field, pattern (group 1 is the value), confidence. The wordings and confidences are fixed values.
PATTERNS: tuple[tuple[str, str, float], ...] = (
    ("manufacturer_name", rf"(?:manufactured{_S}by|mfd\.?{_S}by|mfg\.?{_S}(?:(?:&|and){_S}mkt[dg]?\.?{_S})?by){_SEP}{_NAME}", 0.75),
    ("manufacturer_name", rf"manufacturer{_MUST}{_NAME}", 0.75),
    ("packer_name", rf"(?:packed{_S}by|pkd\.?{_S}by){_SEP}{_NAME}", 0.75),
    ("packer_name", rf"packer{_MUST}{_NAME}", 0.75),
    ("importer_name", rf"imported{_S}by{_SEP}{_NAME}", 0.75),
    ("importer_name", rf"importer{_MUST}{_NAME}", 0.75),
    ("country_of_origin", rf"{_words('country of origin')}{_SEP}([A-Za-z][A-Za-z .]{{1,40}})", 0.8),
    ("net_quantity", rf"net{_S}(?:quantity|qty|weight|wt|volume|vol|contents?)\.?{_SEP}(\p{{Nd}}+(?:\.\p{{Nd}}+)?{_S}(?:{_UNIT}|pieces|pcs|units?|nos?)\b)", 0.85),
    ("mrp", rf"(?:mrp|m\.r\.p\.?|{_words('maximum retail price')}){_SEP}(?:incl[^)]*\)?{_S})?₹?{_S}rs\.?{_S}{_AMOUNT}", 0.85),
    ("mrp", rf"(?:mrp|m\.r\.p\.?){_SEP}₹?{_S}{_AMOUNT}", 0.7),
    ("consumer_care_email", r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", 0.9),
    ("consumer_care_phone", rf"{_words('customer care', 'consumer care', 'helpline', 'toll free', 'call us')}{_SEP}{_PHONE}", 0.75),
    ("consumer_care_name", rf"{_words('consumer care', 'customer care', 'marketed by')}{_SEP}{_LINE}", 0.6),
    ("mfg_date", rf"(?:mfg\.?{_S}date|{_words('manufactured on', 'packed on', 'packaging date')}){_SEP}{_DATE}", 0.7),
    ("best_before_date", rf"(?:{_words('best before', 'use by', 'expiry')}|exp\.?{_S}date){_SEP}{_DATE}", 0.7),
    ("unit_sale_price", rf"(?:{_words('unit sale price')}|price{_S}per{_S}(?:kg|g|l|ml)){_SEP}₹?{_S}{_AMOUNT}", 0.75),
    ("mrp", rf"(?:{_words('अधिकतम खुदरा मूल्य')}|एम\.?{_S}आर\.?{_S}पी\.?|एमआरपी){_SEP}₹?{_S}(?:(?:रु|rs|inr)\.?{_S})?{_AMOUNT}", 0.85),
    ("net_quantity", rf"{_words('शुद्ध मात्रा', 'निवल मात्रा')}{_SEP}(\p{{Nd}}+(?:\.\p{{Nd}}+)?{_S}(?:{_UNIT}|ग्राम|ग्रा\.?|किलोग्राम|किलो|मिलीलीटर|मिली|लीटर)\b)", 0.85),
    ("manufacturer_name", rf"निर्माता{_MUST}{_NAME}", 0.75),
    ("packer_name", rf"पैककर्ता{_MUST}{_NAME}", 0.75),
    ("importer_name", rf"आयातक{_MUST}{_NAME}", 0.75),
    ("country_of_origin", rf"{_words('मूल देश')}{_SEP}([^\p{{Nd}}|\n\r,]{{1,40}})", 0.8),
    ("consumer_care_phone", rf"{_words('उपभोक्ता सेवा', 'ग्राहक सेवा', 'हेल्पलाइन')}{_SEP}{_PHONE}", 0.75),
    ("consumer_care_name", rf"{_words('उपभोक्ता सेवा', 'ग्राहक सेवा')}{_SEP}{_LINE}", 0.6),
    ("mfg_date", rf"{_words('निर्माण तिथि')}{_SEP}{_DATE}", 0.7),
    ("best_before_date", rf"(?:{_words('सर्वोत्तम पूर्व', 'उपयोग तिथि', 'समाप्ति तिथि')}|एक्सपायरी){_SEP}{_DATE}", 0.7),
)

#: A text without any of these (lower-cased) words can't match the pattern of the same place above; the
#: cheap test spares most texts most of the expressions.
ANCHORS: tuple[tuple[str, ...], ...] = (
    ("manufactured", "mfd", "mfg"), ("manufacturer",), ("packed", "pkd"), ("packer",), ("imported",), ("importer",), ("country",), ("net",), ("rs",), ("mrp", "m.r.p"), ("@",),
    ("care", "helpline", "toll", "call"), ("care", "marketed"), ("mfg", "manufactured", "packed", "packaging"), ("best", "use", "expiry", "exp"), ("unit", "price"),
    ("अधिकतम", "एम", "एमआरपी"), ("शुद्ध", "निवल"), ("निर्माता",), ("पैककर्ता",), ("आयातक",), ("मूल",), ("उपभोक्ता", "ग्राहक", "हेल्पलाइन"), ("उपभोक्ता", "ग्राहक"), ("निर्माण",),
    ("सर्वोत्तम", "उपयोग", "समाप्ति", "एक्सपायरी"),
)

#: Values that are licence or registration numbers, not names.
NOT_A_NAME = r"(?i)^(?:(?:fssai\s*)?lic(?:en[cs]e)?\.?\s*no\.?\b|fssai\b|gst(?:in)?\b|cin\b|reg(?:istration)?\.?\s*no\.?\b)"
ADDRESS_CONFIDENCE = 0.55
ONE = "struct<field_name:string,field_value:string,confidence:double,ord:int>"


def clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"^[,;]+|[,;]+$", "")


def _row(field: str, value: Column, confidence: float, ord_: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field_name"), value.alias("field_value"), F.lit(confidence).alias("confidence"), ord_.cast("int").alias("ord")
    )


def _address(name: Column, after: Column) -> Column:
    """The address in the characters after a name, up to its PIN code; empty where there is none or the name is no name."""
    found = F.regexp_replace(F.regexp_extract(after, r"^[\s\S]*?\b\d{6}\b", 0), r"^[\s,;:|\-]+", "")
    return F.when(name.rlike(NOT_A_NAME) | (name == ""), F.lit("")).otherwise(found)


def _guarded(text: Column, low: Column, k: int, of=None, row: str = ONE) -> Column:
    """The candidates of pattern k, or none where the text lacks its anchors."""
    may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ANCHORS[k]])
    none = F.array().cast(f"array<{row}>")
    return F.when(may, (of or _of)(text, k, *PATTERNS[k]).cast(f"array<{row}>")).otherwise(none)


def _of(text: Column, k: int, field: str, pattern: str, confidence: float) -> Column:
    base = 1000 * (k + 1)
    if field not in ADDRESS_OF:
        values = F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(1))
        rows = F.transform(values, lambda v, i: _row(field, clean(v), confidence, i * 2 + base))
        return F.filter(rows, lambda r: r["field_value"] != "")
    ahead = F.lit(rf"(?iu){pattern}(?=([\s\S]{{0,220}}))")
    both = F.arrays_zip(F.regexp_extract_all(text, ahead, F.lit(1)).alias("v"), F.regexp_extract_all(text, ahead, F.lit(2)).alias("w"))
    rows = F.flatten(
        F.transform(
            both,
            lambda x, i: F.array(
                _row(field, clean(x["v"]), confidence, i * 2 + base),
                _row(ADDRESS_OF[field], _address(clean(x["v"]), x["w"]), ADDRESS_CONFIDENCE, i * 2 + 1 + base),
            ),
        )
    )
    return F.filter(rows, lambda r: (r["field_value"] != "") & ~((r["field_name"] == field) & r["field_value"].rlike(NOT_A_NAME)))


def candidates(text: Column) -> Column:
    """array<struct<field_name, field_value, confidence, ord>> of all matches of all patterns."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    return F.concat(*[_guarded(text, low, k) for k in range(len(PATTERNS))])


def pattern_candidates(text: Column, field: str) -> Column:
    """The same for the patterns of one field only."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    return F.concat(*[_guarded(text, low, k) for k, p in enumerate(PATTERNS) if p[0] == field])


#: Characters shown on either side of a match, and characters behind a name in which its address is looked for.
AROUND, AHEAD = 20, 220
LOCATED = "struct<field_name:string,field_value:string,confidence:double,ord:int,start_at:int,end_at:int,snippet:string>"


def _located(text: Column, k: int, field: str, pattern: str, confidence: float) -> Column:
    """As _of, with places. Each match is taken with the gap before it, from the end of the last match on (\\G), so the lengths
    of the pieces add up to offsets in one pass and no text is searched twice."""
    base = 1000 * (k + 1)
    found = lambda g: F.regexp_extract_all(text, F.lit(rf"(?iu)\G([\s\S]*?)(?:{pattern})(?=([\s\S]{{0,{AHEAD}}}))"), F.lit(g))
    pieces = F.arrays_zip(found(0).alias("piece"), found(1).alias("gap"), found(2).alias("v"), found(3).alias("ahead"))

    def rows(p: Column, at: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            # every piece has a character or more, so the last AROUND of them hold what is shown before the match
            last = F.transform(upto(F.greatest(i - AROUND, F.lit(0)), i), lambda j: F.right(F.get(p, j)["piece"], F.lit(AROUND)))
            before = F.right(F.concat(F.array_join(last, ""), x["gap"]), F.lit(AROUND))
            match = F.substring(x["piece"], F.length(x["gap"]) + 1, F.length(x["piece"]))
            start, end = F.get(at, i) + F.length(x["gap"]), F.get(at, i) + F.length(x["piece"])
            shown = lambda after: strip(F.concat(before, match, after)).alias("snippet")
            row = lambda name, v, c, o, after: F.struct(
                F.lit(name).alias("field_name"), v.alias("field_value"), F.lit(c).alias("confidence"), o.cast("int").alias("ord"),
                start.cast("int").alias("start_at"), end.cast("int").alias("end_at"), shown(after),
            )
            value = clean(x["v"])
            if field not in ADDRESS_OF:
                return F.array(row(field, value, confidence, i * 2 + base, F.left(x["ahead"], F.lit(AROUND))))
            name = F.when(value.rlike(NOT_A_NAME), F.lit("")).otherwise(value)
            return F.array(
                row(field, name, confidence, i * 2 + base, F.left(x["ahead"], F.lit(AROUND))),
                row(ADDRESS_OF[field], _address(value, x["ahead"]), ADDRESS_CONFIDENCE, i * 2 + 1 + base, x["ahead"]),
            )

        return F.filter(F.flatten(F.transform(p, one)), lambda r: r["field_value"] != "")

    return let(pieces, lambda p: let(running(F.transform(p, lambda x: F.length(x["piece"]))), lambda at: rows(p, at)))


def located(text: Column) -> Column:
    """candidates() with the place of each match (code points from 0, end exclusive) and what stands around it: 20 characters
    on either side, for an address all in which it was looked for. An address has the place of its name's match."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    return F.concat(*[_guarded(text, low, k, _located, LOCATED) for k in range(len(PATTERNS))])
