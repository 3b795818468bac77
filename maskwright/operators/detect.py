"""Detectors: each is an expression from the normalised text to an array of candidates.

Detectors do not depend on one another, so a plan holds only those whose types are asked for, and each looks at
a text only where a cheap test finds what it must contain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import text as t
from maskwright.schema import CANDIDATE, ENTITY_TYPES, SPAN, InvalidInput

# Patterns, scores and words of the rules.
EMAIL = r"(?<![A-Za-z0-9.!#$%&'*+/=?^`{|}~-])[A-Za-z0-9.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
POSTAL = r"(?<!\d)(?:〒\s*)?\d{3}[-ー]?\d{4}(?!\d|[-ー]\d)"
PHONE = r"(?<!\d)(?:(?:\+81[-ー\s]?(?:0)?\d{1,4})|(?:0\d{1,4})|(?:\(0\d{1,4}\)))[-ー\s]?\d{1,4}[-ー\s]?\d{3,4}(?!\d)"
URL = r"https?://[^\s<>()\[\]{}、。]+"
_NUMBER = "[0-9一二三四五六七八九十百千]+"
ADDRESS = (
    r"(?:東京都|北海道|(?:京都|大阪)府|.{2,3}県)[^\s、。;；]{1,60}?"
    rf"(?:(?:{_NUMBER}(?:丁目|番地?|番|号)){{1,4}}|{_NUMBER}(?:[-ー]{_NUMBER}){{1,3}})"
)
DATE = r"(?<!\d)(?:(?:19|20)\d{2}年)?\d{1,2}月\d{1,2}日(?!\d)|(?<!\d)(?:19|20)\d{2}([/.-])\d{1,2}\1\d{1,2}(?!\d)"
TWELVE_DIGITS = r"(?<!\d)\d{12}(?!\d)"
SEVEN_OR_EIGHT_DIGITS = r"(?<!\d)\d{7,8}(?!\d)"
_RECORD = "登録値|確認対象|申請書|記録された値"
_AFTER_RECORD = r"(?:には|は|[:：])?\s*"
PERSON = (
    rf"((?:氏名|担当者|申請者|{_RECORD}){_AFTER_RECORD})"
    r"([A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){1,2}|[一-龯々髙﨑]{2,8}|[ぁ-ゖー]{4,12}|[ァ-ヶー]{4,16})(?=さん|様|氏|先生)"
)
ORGANIZATION = (
    rf"((?:{_RECORD}){_AFTER_RECORD})"
    r"((?:株式会社|合同会社|有限会社|一般社団法人|一般財団法人|医療法人|学校法人|社会福祉法人)[^\s、。;；／]{1,30}?"
    r"|[一-龯々ぁ-ゖァ-ヶーA-Za-z0-9・&＆]{2,30}?(?:研究所|大学|病院|協会|財団|銀行|支店)[0-9]{0,4})(?=です|でした|である|／|、|。|$)"
)
LOCATION = r"[一-龯々]{1,8}(?:都|道|府|県|市|区|町|村)(?=が配送地域|の会場|への出張|を担当|から届)"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
#: Digits that stand together in a match, with the blank or hyphen that ends it.
CARD_RUN = r"(?<!\d)\d{13,19}(?!\d)(?:[ -](?!\d))?"
#: A chain of more digits than a card's number holds several numbers; so many characters beside a match show whether it has.
CARD_DIGITS, CARD_BESIDE = 19, 14
#: Whole runs of address characters that have two separators at least, as every address does.
IP_RUN = r"(?<![0-9A-Fa-f:.])(?=[0-9A-Fa-f:.]*[:.][0-9A-Fa-f:.]*[:.])[0-9A-Fa-f:.]{3,}(?![0-9A-Fa-f:.])"
NOT_A_PHONE_AFTER = ("型番", "品番", "商品コード", "注文番号", "受付番号", "管理番号")
POLITE_ENDINGS = "(でした|です|ました|ます)$"
CONTEXTS = {
    "PERSONAL_ID": (TWELVE_DIGITS, ("マイナンバー", "個人番号"), 0.94),
    "DRIVER_LICENSE": (TWELVE_DIGITS, ("免許証", "免許番号"), 0.9),
    "BANK_ACCOUNT": (SEVEN_OR_EIGHT_DIGITS, ("口座", "普通", "当座"), 0.82),
}
#: Scores of the four structural patterns in each profile; and the profile's source.
PROFILES = {
    "local": ("local-pattern", dict.fromkeys(("EMAIL_ADDRESS", "POSTAL_CODE", "PHONE_NUMBER", "URL"), 0.85)),
    "pattern": ("presidio-pattern", {"EMAIL_ADDRESS": 0.92, "POSTAL_CODE": 0.88, "PHONE_NUMBER": 0.78, "URL": 0.9}),
}


def candidates(spans: Column, entity_type: str, score: float, source: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(F.lit(entity_type).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(score).alias("score"), F.lit(source).alias("source")),
    ).cast(f"array<{CANDIDATE}>")


def _span(start: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))


def _structural(norm: Column, entity_type: str, profile: str) -> Column:
    source, scores = PROFILES[profile]
    spans = STRUCTURAL[entity_type](norm, t.PYTHON_FLAGS_ANY_CASE)
    return candidates(spans, entity_type, scores[entity_type], source)


def email_spans(norm: Column, flags: str = t.PYTHON_FLAGS_ANY_CASE) -> Column:
    return t.mark_spans(norm, flags + EMAIL, guard=F.contains(norm, F.lit("@")))


def postal_spans(norm: Column, flags: str = t.PYTHON_FLAGS_ANY_CASE) -> Column:
    spans = t.mark_spans(norm, flags + POSTAL, guard=norm.rlike(r"(?U)\d{4}"))
    return F.filter(spans, lambda s: t.has_any(s["text"], ("〒", "-", "ー")) | F.contains(t.before(norm, s["start"], 16), F.lit("郵便")))


def phone_spans(norm: Column, flags: str = t.PYTHON_FLAGS_ANY_CASE) -> Column:
    spans = t.mark_spans(norm, flags + PHONE, guard=norm.rlike(r"(?U)\d{3}"))
    return F.filter(spans, lambda s: ~t.has_any(t.before(norm, s["start"], 16), NOT_A_PHONE_AFTER))


def url_spans(norm: Column, flags: str = t.PYTHON_FLAGS_ANY_CASE) -> Column:
    spans = t.mark_spans(norm, flags + URL, guard=F.contains(norm, F.lit("://")))
    cut = F.transform(spans, lambda s: _span(s["start"], F.regexp_replace(s["text"], POLITE_ENDINGS, "")))
    return F.filter(cut, lambda s: s["end"] - s["start"] > len("https://"))


STRUCTURAL: dict[str, Callable[[Column, str], Column]] = {"EMAIL_ADDRESS": email_spans, "POSTAL_CODE": postal_spans, "PHONE_NUMBER": phone_spans, "URL": url_spans}


def address_spans(norm: Column) -> Column:
    return t.mark_spans(norm, t.PYTHON_FLAGS + ADDRESS, guard=norm.rlike("[都道府県]"))


def date_spans(norm: Column) -> Column:
    return t.mark_spans(norm, t.PYTHON_FLAGS + DATE, guard=norm.rlike(r"(?U)月\d|\d[/.-]\d"))


def context_number_spans(norm: Column, entity_type: str) -> Column:
    pattern, words, _ = CONTEXTS[entity_type]
    spans = t.mark_spans(norm, t.PYTHON_FLAGS + pattern, guard=t.has_any(norm, words))
    return F.filter(spans, lambda s: t.has_any(t.around(norm, s["start"], s["end"], 20, 10), words))


def person_spans(norm: Column) -> Column:
    return t.mark_spans(norm, t.PYTHON_FLAGS + PERSON, group=2, guard=norm.rlike("さん|様|氏|先生"))


def organization_spans(norm: Column) -> Column:
    return t.mark_spans(norm, t.PYTHON_FLAGS + ORGANIZATION, group=2, guard=norm.rlike(_RECORD))


def location_spans(norm: Column) -> Column:
    return t.mark_spans(norm, t.PYTHON_FLAGS + LOCATION, guard=norm.rlike("が配送地域|の会場|への出張|を担当|から届"))


def card_spans(norm: Column, alone: bool = False) -> Column:
    """Matches that pass the check; with ``alone``, also runs that pass it by themselves in matches that fail it, in chains of several numbers.

    The pattern joins a card with a short number beside it; what is written in one piece is then the card.
    """
    spans = t.mark_spans(norm, t.PYTHON_FLAGS + CARD, guard=norm.rlike(r"(?U)(?:\d[ -]?){13}"))
    none = F.array().cast(f"array<{SPAN}>")

    def valid(s: Column) -> Column:
        digits = t.ascii_digits(t.only_digits(s["text"]))
        return F.length(digits).between(13, CARD_DIGITS) & t.luhn(digits)

    def several(s: Column) -> Column:
        left = F.regexp_extract(t.before(norm, s["start"], CARD_BESIDE), r"(?U)(?:\d[ -]?)*\z", 0)
        right = F.regexp_extract(F.substring(norm, s["end"] + 1, F.lit(CARD_BESIDE)), r"(?U)\A(?:[ -]?\d)*", 0)
        ended = s["text"].rlike(r"[ -]\z")
        return F.length(t.only_digits(F.concat(left, s["text"], F.when(ended, "").otherwise(right)))) > CARD_DIGITS

    def runs_of(s: Column) -> Column:
        runs = F.transform(t.mark_spans(s["text"], t.PYTHON_FLAGS + CARD_RUN), lambda r: _span(s["start"] + r["start"], r["text"]))
        return F.filter(runs, valid)

    if not alone:
        return F.filter(spans, valid)
    return F.flatten(F.transform(spans, lambda s: F.when(valid(s), F.array(s)).when(several(s), runs_of(s)).otherwise(none)))


def ip_spans(norm: Column) -> Column:
    runs = t.mark_spans(norm, t.PYTHON_FLAGS + IP_RUN, guard=norm.rlike(r"[:.][0-9A-Fa-f]*[:.]"))

    def trimmed(s: Column) -> Column:
        left = F.regexp_replace(s["text"], r"^\.+", "")
        return _span(s["start"] + F.length(s["text"]) - F.length(left), F.regexp_replace(left, r"\.+$", ""))

    return F.filter(F.transform(runs, trimmed), lambda s: t.is_ip(s["text"]))


#: In the order in which candidates are listed; ties in ranking fall back to it.
RULES: dict[str, Callable[[Column, str], Column]] = {
    **{e: (lambda norm, profile, e=e: _structural(norm, e, profile)) for e in STRUCTURAL},
    "ADDRESS": lambda norm, _: candidates(address_spans(norm), "ADDRESS", 0.76, "jp-address-rule"),
    "DATE_TIME": lambda norm, _: candidates(date_spans(norm), "DATE_TIME", 0.72, "date-rule"),
    **{e: (lambda norm, _, e=e: candidates(context_number_spans(norm, e), e, CONTEXTS[e][2], "jp-context-rule")) for e in CONTEXTS},
    "PERSON": lambda norm, _: candidates(person_spans(norm), "PERSON", 0.86, "jp-person-context-rule"),
    "ORGANIZATION": lambda norm, _: candidates(organization_spans(norm), "ORGANIZATION", 0.86, "jp-organization-context-rule"),
    "LOCATION": lambda norm, _: candidates(location_spans(norm), "LOCATION", 0.84, "jp-location-context-rule"),
    "CREDIT_CARD": lambda norm, _: candidates(card_spans(norm, alone=True), "CREDIT_CARD", 0.97, "luhn-rule"),
    "IP_ADDRESS": lambda norm, _: candidates(ip_spans(norm), "IP_ADDRESS", 0.98, "ip-validator"),
}


def enabled_types(entities: Iterable[str] | None) -> list[str]:
    """What is asked for; None or nothing means every catalogue type."""
    return sorted(set(entities or ())) or list(ENTITY_TYPES)


def detect(norm: Column, entities: Iterable[str] | None = None, profile: str = "local") -> Column:
    """Candidates of all rules for the types asked for, in the rules' order.  ``norm`` should be a column, not an expression."""
    if profile not in PROFILES:
        raise InvalidInput(f"profile is one of {sorted(PROFILES)}")
    wanted = enabled_types(entities)
    found = [rule(norm, profile) for e, rule in RULES.items() if e in wanted]
    return F.concat(*found) if found else F.array().cast(f"array<{CANDIDATE}>")
