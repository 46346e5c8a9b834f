"""The fifteen recognizers, their context words and jurisdictions; selection happens while the plan is built."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as V

JURISDICTIONS = ("SG", "HK", "JP", "AU", "US")
WORD = r"[\p{L}\p{N}_]"
#: A word boundary over letters, numbers of all kinds and the underscore.
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


@dataclass(frozen=True)
class Recognizer:
    """A pattern with what confirms it. plain and boosted are the confidences it can emit."""

    name: str
    entity: str
    pattern: str
    plain: float
    boosted: float
    context: tuple[str, ...]
    validator: Callable[[Column], Column] | None = None
    needs_context: bool = False
    jurisdiction: str = "GLOBAL"
    #: Every match holds one of these characters; a text without them is passed over.
    guard: str = r"\d"
    #: No match holds, or depends on, a place where detect.BREAK matches, so texts may be cut there; else texts are scanned whole.
    breaks: bool = False

    #: Characters one of which every match begins with, if told: other places are passed over before boundaries are looked at.
    first: str = ""
    #: The least and the most letters, digits and other characters of a match (most may be None), if told: other values are not tested.
    makeup: tuple[tuple[int, int | None], ...] = ()

    def fits(self, letters: Column, digits: Column, others: Column) -> Column:
        """Whether a whole value of so many letters, digits and other characters can be a match."""
        fit = F.lit(True)
        for number, (least, most) in zip((letters, digits, others), self.makeup, strict=False):
            fit = fit & (number >= least if most is None else number == least if least == most else number.between(least, most))
        return fit

    @property
    def regex(self) -> str:
        return "(?U)" + (f"(?={self.first})" if self.first else "") + self.pattern


# Shapes, confidences and context words of the identifiers (context words are substrings of the lower-cased
# surroundings). Boundaries are written so that they mean the same to Java as they do in the definitions.
_PHONE_WORDS = ("phone", "mobile", "tel", "call", "contact", "whatsapp", "hp", "電話", "携帯", "連絡先")
_SHAPES: tuple[Recognizer, ...] = (
    Recognizer("email", "EMAIL_ADDRESS", rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{EDGE}", 0.9, 0.99, ("email", "e-mail", "mail", "メール"), guard="@"),
    Recognizer("credit_card", "CREDIT_CARD", r"(?<![\dA-Za-z])(?:\d[ -]?){12,18}\d(?![\dA-Za-z])", 0.98, 0.99, ("card", "visa", "mastercard", "amex", "credit", "debit", "カード", "クレジット"), V.luhn),
    Recognizer("iban", "IBAN", rf"{EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{EDGE}", 0.98, 0.99, ("iban", "account", "transfer", "bank", "口座", "銀行", "振込"), V.iban),
    Recognizer("sg_nric", "SG_NRIC", rf"{EDGE}[STFGMstfgm]\d{{7}}[A-Za-z]{EDGE}", 0.98, 0.99, ("nric", "fin", "identity", "ic number", "uin"), V.sg_nric, jurisdiction="SG"),
    Recognizer("hk_hkid", "HK_HKID", rf"{EDGE}[A-Z]{{1,2}}\d{{6}}\(?[0-9A]\)?", 0.98, 0.99, ("hkid", "identity card", "identity"), V.hk_hkid, jurisdiction="HK"),
    Recognizer("jp_my_number", "JP_MY_NUMBER", r"(?<!\d)(?<!\d[- ])\d{4}[- ]?\d{4}[- ]?\d{4}(?![- ]?\d)", 0.98, 0.99, ("my number", "mynumber", "マイナンバー", "個人番号"), V.jp_my_number, jurisdiction="JP"),
    Recognizer("au_tfn", "AU_TFN", r"(?<!\d)\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)", 0.65, 0.85, ("tfn", "tax file"), V.au_tfn, True, "AU"),
    Recognizer("au_abn", "AU_ABN", r"(?<!\d)\d{2} ?\d{3} ?\d{3} ?\d{3}(?!\d)", 0.98, 0.99, ("abn", "business number"), V.au_abn, jurisdiction="AU"),
    Recognizer("au_medicare", "AU_MEDICARE", r"(?<!\d)[2-6]\d{3} ?\d{5} ?\d(?: ?/? ?\d)?(?!\d)", 0.98, 0.99, ("medicare",), V.au_medicare, jurisdiction="AU"),
    Recognizer("us_ssn", "US_SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", 0.8, 0.99, ("ssn", "social security"), V.us_ssn, jurisdiction="US"),
    Recognizer("ip_address", "IP_ADDRESS", rf"{EDGE}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{EDGE}", 0.75, 0.95, ("ip", "address", "host", "server", "ipアドレス", "サーバー"), V.ipv4, guard=r"\d\.\d"),
    Recognizer("phone_intl", "PHONE_NUMBER", r"(?<![.\p{L}\p{N}_])\+\d{1,3}(?:[ -]\d{1,4}){1,4}(?![\d.])|(?<![.\p{L}\p{N}_])\+\d{8,15}(?![\d.])", 0.6, 0.8, _PHONE_WORDS, V.phone, guard=r"\+\d"),
    Recognizer("phone_local", "PHONE_NUMBER", r"(?<![.\p{L}\p{N}_])(?:\(\d{2,4}\)[ -]?)?\d{2,4}[ -]\d{3,4}(?:[ -]\d{3,4})?(?![\d.])", 0.5, 0.7, _PHONE_WORDS, V.phone, True),
    Recognizer("passport", "PASSPORT", rf"{EDGE}[A-Z]{{1,2}}\d{{6,8}}{EDGE}", 0.4, 0.6, ("passport", "パスポート", "旅券"), None, True),
    Recognizer("date_of_birth", "DATE_OF_BIRTH", rf"(?i){EDGE}(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{{4}}){EDGE}", 0.75, 0.95, ("born", "birth", "dob", "d.o.b", "birthday", "生年月日", "誕生日", "出生"), V.date_of_birth, True),
)
_FIRST = {"email": "[A-Za-z0-9._%+-]", "iban": "[A-Z]", "sg_nric": "[STFGMstfgm]", "hk_hkid": "[A-Z]", "au_medicare": "[2-6]", "phone_intl": r"\+", "phone_local": r"[\d(]", "passport": "[A-Z]"}
# Letters, digits and others that the patterns above ask for.
_MAKEUP = {
    "email": ((2, None), (0, None), (2, None)),
    "credit_card": ((0, 0), (13, 19), (0, 18)),
    "iban": ((2, 33), (2, 33), (0, 8)),
    "sg_nric": ((2, 2), (7, 7), (0, 0)),
    "hk_hkid": ((1, 3), (6, 7), (0, 2)),
    "jp_my_number": ((0, 0), (12, 12), (0, 2)),
    "au_tfn": ((0, 0), (9, 9), (0, 2)),
    "au_abn": ((0, 0), (11, 11), (0, 3)),
    "au_medicare": ((0, 0), (10, 11), (0, 5)),
    "us_ssn": ((0, 0), (9, 9), (2, 2)),
    "ip_address": ((0, 0), (4, 12), (3, 3)),
    "phone_intl": ((0, 0), (2, 19), (1, 5)),
    "phone_local": ((0, 0), (5, 16), (1, 5)),
    "passport": ((1, 2), (6, 8), (0, 0)),
    "date_of_birth": ((0, None), (4, 8), (2, 2)),
}
RECOGNIZERS: tuple[Recognizer, ...] = tuple(replace(r, breaks=True, first=_FIRST.get(r.name, r"\d"), makeup=_MAKEUP[r.name]) for r in _SHAPES)



def select(jurisdictions: Iterable[str] = JURISDICTIONS) -> tuple[Recognizer, ...]:
    """The global recognizers and those of the named packs, in the fixed order."""
    wanted = {str(j).strip().upper() for j in jurisdictions}
    if not wanted:
        raise ValueError("select at least one jurisdiction")
    if strange := sorted(wanted.difference(JURISDICTIONS)):
        raise ValueError(f"unknown jurisdictions: {', '.join(strange)}")
    return tuple(r for r in RECOGNIZERS if r.jurisdiction in wanted | {"GLOBAL"})
