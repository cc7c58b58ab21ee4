"""Normal forms and digests that need Python's Unicode tables or its JSON text, over Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_WORD = re.compile(r"\w+")


def label_form(text: str) -> str:
    """NFC, case-folded, words joined by a space."""
    return " ".join(_WORD.findall(unicodedata.normalize("NFC", text).casefold()))


def claim_form(text: str) -> str:
    """NFKC, case-folded, white space collapsed, without punctuation at the ends."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split()).strip(' .!?;:"“”')


@pandas_udf(StringType())
def normal_label(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else label_form(t))


@pandas_udf(StringType())
def normal_claim(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else claim_form(t))


def canonical_json(value: object, compact: bool = False, ascii_only: bool = True) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=ascii_only, separators=(",", ":") if compact else None)


def digest(value: object, compact: bool = False, ascii_only: bool = True) -> str:
    return hashlib.sha256(canonical_json(value, compact, ascii_only).encode()).hexdigest()


def client_hash(secret: bytes):
    """A column function: HMAC-SHA256 of each client name."""

    @pandas_udf(StringType())
    def hashed(clients: pd.Series) -> pd.Series:
        return clients.map(lambda c: None if c is None else hmac.new(secret, str(c).encode(), hashlib.sha256).hexdigest())

    return hashed
