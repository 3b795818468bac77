"""Fixed types, the catalogue of entity types, and the errors callers may meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Identifiers, labels and groups of the entity types, in catalogue order.
CATALOGUE = (
    ("PERSON", "人名", "固有表現"),
    ("ORGANIZATION", "組織名", "固有表現"),
    ("LOCATION", "地名", "固有表現"),
    ("ADDRESS", "住所", "日本固有"),
    ("PHONE_NUMBER", "電話番号", "連絡先"),
    ("POSTAL_CODE", "郵便番号", "連絡先"),
    ("EMAIL_ADDRESS", "メールアドレス", "連絡先"),
    ("PERSONAL_ID", "マイナンバー候補", "識別番号"),
    ("DRIVER_LICENSE", "運転免許証番号候補", "識別番号"),
    ("BANK_ACCOUNT", "銀行口座番号候補", "金融"),
    ("CREDIT_CARD", "クレジットカード", "金融"),
    ("DATE_TIME", "日付・時刻", "その他"),
    ("URL", "URL", "ネットワーク"),
    ("IP_ADDRESS", "IPアドレス", "ネットワーク"),
    ("CUSTOM", "ユーザー定義", "ユーザー定義"),
)
ENTITY_TYPES = tuple(c[0] for c in CATALOGUE)
LABELS = {c[0]: c[1] for c in CATALOGUE}

# Who wins where spans overlap; a source that is not listed has 1.
PRIORITY = {
    "pii-dictionary": 5,
    "luhn-rule": 4,
    "jp-context-rule": 4,
    "ip-validator": 4,
    "presidio-pattern": 3,
    "local-pattern": 3,
    "jp-address-rule": 3,
    "date-rule": 3,
    "jp-person-context-rule": 3,
    "jp-organization-context-rule": 3,
    "jp-location-context-rule": 3,
    "ginza": 2,
}

MAX_TEXT = 500_000
MAX_TERM = 200
MAX_NOTE = 500
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MANUAL_SOURCE = "manual-selection"

SPAN = "struct<start:int,end:int,text:string>"
CANDIDATE = "struct<entity_type:string,start:int,end:int,score:double,source:string>"
FINDING = "struct<id:string,entity_type:string,start:int,end:int,text:string,score:double,source:string,block_id:string>"
BLOCKS = "doc_id string, block_id string, text string"
DICTIONARY = "id long, term string, entity_type string, note string, created_at string"
SAMPLE = (
    "id string, language string, split string, source string, generator_version string, template_id string, text string, "
    "entities array<struct<entity_type:string,start:int,end:int,text:string>>, dictionary_terms array<struct<term:string,entity_type:string>>, "
    "enabled_entities array<string>, tags array<string>, notes string"
)


class MaskwrightError(ValueError):
    """What callers can set right; ``status`` is the kind of answer a service would give."""

    status = 400


class InvalidInput(MaskwrightError):
    status = 422


class NotFound(MaskwrightError):
    status = 404


class Conflict(MaskwrightError):
    status = 409


class Unsupported(MaskwrightError):
    status = 400


def entity_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "id string, label string, `group` string")


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
