"""Reading model replies: JSON in prose, and identities of judges."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"\A\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*\Z")


def parse_reply(text: str):
    """The JSON value of a reply: without its code fence, as a whole, else the first value
    that begins at a bracket. No value raises ValueError."""
    bare = _FENCE.sub("", text).strip()
    decoder = json.JSONDecoder()
    try:
        return json.loads(bare)
    except ValueError:
        pass
    for found in re.finditer(r"[\[{]", bare):
        try:
            return decoder.raw_decode(bare, found.start())[0]
        except ValueError:
            continue
    raise ValueError(f"no JSON value in {text[:80]!r}")


def reply_json(c: Column) -> Column:
    """The reply's JSON value as compact text, or null without one."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(parse_reply(t), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return parse(c)


def consistent(reply: Column) -> Column:
    """Verdict of the semantic check: what fails or can't be read is kept."""
    value = F.get_json_object(reply_json(reply), "$.consistent")
    return F.coalesce(~F.lower(value).isin("false", "0", "null", ""), F.lit(True))


def judge_identity(model: str, settings: dict, defaults: dict) -> str:
    """The model's name, with a short digest of its settings where they are not the default."""
    if settings == defaults:
        return model
    raw = json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()
    return f"{model}@{hashlib.sha256(raw).hexdigest()[:16]}"


def endpoint(base: str, path: str) -> str:
    """A service's URL for a path, whether or not the base ends in it."""
    base = base.rstrip("/")
    return base if base.endswith(path) else base + path
