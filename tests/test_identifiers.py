import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from tallyforge.functions.text import HINTS
from tallyforge.plans.addresses import identifier_tokens

EDGE = ".,;:!?()[]{}<>\"'`|/\\*+~=·•$#"
TEXTS = [
    "MODÈLE42 and modèle42, ÜB-1204\n(straße-77) Ünïcode x1 é1 model 4711é",
    "model: ١٢٣٤٥ code 1234 1234 sku 11112 12345678 É12É34\nＡＢＣ１２３ ÑÑÑÑ1 ¼¼¼¼AB ABC-12",
    "модель АБ-1204 型番X100A 型番100 A\u030212345 №12345 é-1-é",
    "item 𝐀𝐁12 𝐀𝟏𝟐𝟑𝟒 𝐀𝐀𝟏𝟏𝟏 𝐀𝐀𝐀𝟏𝟐 xx𝟏xx",
    None,
    "",
]


def brute(text):
    out = []
    for line in (text or "").split("\n"):
        hinted = any(h in line.lower() for h in HINTS)
        for raw in filter(None, re.split("[ \t\v\f\r:#]+", line)):
            token = raw.strip(EDGE).upper().strip("-_.")
            kinds = [c if c in "-_." else unicodedata.category(c)[0] for c in token]
            digits, letters = kinds.count("N"), kinds.count("L")
            if not 4 <= len(token) <= 24 or set(kinds) - set("-_.LN") or not digits or len(set(token)) < 3:
                continue
            if len(token) >= 5 if letters else 8 <= digits <= 14 or (hinted and 4 <= digits <= 7):
                out.append(token)
    return out


def test_identifiers_of_any_script(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": list(range(len(TEXTS))), "text": pa.array(TEXTS, pa.string())}), tmp_path / "documents.parquet")
    want = {(d, t): n for d, text in enumerate(TEXTS) for t, n in Counter(brute(text)).items()}
    got = {(r.doc_id, r.identifier): r.n for r in identifier_tokens(spark, str(tmp_path)).collect()}
    assert got == want
    assert {(0, "MODÈLE42"), (0, "ÜB-1204"), (0, "STRASSE-77"), (2, "АБ-1204")} < set(want) and want[0, "MODÈLE42"] == 2
