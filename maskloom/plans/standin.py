"""A deterministic stand-in for the caller's entity model, used by the
registered NER queries.  It is not part of the library: the library takes any
``model(chunk) -> response`` callable.

Rule: every ASCII capitalised word of at least six letters is an organisation
(``机构名``, the model vocabulary); odd-length words carry a confidence, even
ones omit it (so the 0.95 default applies); offsets are never given (so they
are located in the chunk).  Chunks without hits get prose without JSON.
The same rule is written three times: Spark built-ins (derived responses
table), DuckDB (oracle), Python (the ``mapInPandas`` hook).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_RE = r"[A-Z][a-z]{5,}"
MODEL_TYPE = "机构名"
PREFIX = "识别结果："
SUFFIX = "\n以上。"
NONE = "未发现实体"


def _prob(n):  # n = length of the span
    return (n % 7) / 10.0 + 0.3


def spark_response(chunk: Column) -> Column:
    spans = F.regexp_extract_all(chunk, F.lit(WORD_RE), 0)
    objs = F.transform(
        spans,
        lambda s: F.when(
            F.char_length(s) % 2 == 1,
            F.to_json(F.struct(s.alias("span"), F.lit(MODEL_TYPE).alias("type"),
                               ((F.char_length(s) % 7) / 10.0 + 0.3).alias("prob"))),
        ).otherwise(F.to_json(F.struct(s.alias("span"), F.lit(MODEL_TYPE).alias("type")))),
    )
    return F.when(F.size(spans) == 0, F.lit(NONE)).otherwise(
        F.concat(F.lit(PREFIX + "["), F.array_join(objs, ", "), F.lit("]" + SUFFIX))
    )


def duck_response(chunk: str) -> str:
    objs = (
        f"list_transform(regexp_extract_all({chunk}, '{WORD_RE}', 0), lambda s: CASE WHEN length(s) % 2 = 1 "
        f"THEN to_json({{'span': s, 'type': '{MODEL_TYPE}', 'prob': (length(s) % 7) / 10.0 + 0.3}})::VARCHAR "
        f"ELSE to_json({{'span': s, 'type': '{MODEL_TYPE}'}})::VARCHAR END)"
    )
    return (
        f"CASE WHEN len(regexp_extract_all({chunk}, '{WORD_RE}', 0)) = 0 THEN '{NONE}' "
        f"ELSE '{PREFIX}[' || array_to_string({objs}, ', ') || ']' || chr(10) || '以上。' END"
    )


_word = re.compile(WORD_RE)


def python_model(chunk: str) -> str:
    spans = _word.findall(chunk or "")
    if not spans:
        return NONE
    objs = []
    for s in spans:
        o = {"span": s, "type": MODEL_TYPE}
        if len(s) % 2 == 1:
            o["prob"] = _prob(len(s))
        objs.append(json.dumps(o, ensure_ascii=False, separators=(",", ":")))
    return PREFIX + "[" + ", ".join(objs) + "]" + SUFFIX
