import pytest

from troughline import vocabulary as V
from troughline.operators import responses as R

GOOD = '{"observed": "deep dip", "call": "occlusion_signature_present", "confidence": 0.82, "rationale": "clear"}'
CASES = {
    # text: (parsed_ok, schema_complete, call, confidence, part of the error)
    GOOD: (True, True, V.PRESENT, 0.82, None),
    '{"observed": "flat", "call": "No_Occlusion_Signature", "confidence": 1.7, "rationale": "flat"}': (True, True, V.ABSENT, 1.0, None),
    '{"call": "indeterminate", "confidence": -3}': (True, False, V.INDETERMINATE, 0.0, None),
    '{"call": "maybe", "confidence": 0.5}': (False, False, None, None, "invalid or missing call: 'maybe'"),
    '{"confidence": 0.5}': (False, False, None, None, "invalid or missing call: None"),
    '{"call": "ipsilateral", "confidence": 0.9, "rationale": "x"}': (False, False, None, None, "legacy_call_value: 'ipsilateral'"),
    '{"call": "not_ipsilateral", "confidence": 0.4}': (False, False, None, None, "legacy_call_value: 'not_ipsilateral'"),
    '{"call": "indeterminate", "confidence": "high"}': (False, False, V.INDETERMINATE, None, "non-numeric confidence"),
    '{"call": "indeterminate", "confidence": true}': (False, False, V.INDETERMINATE, None, "non-numeric confidence"),
    '{"call": "indeterminate", "confidence": null}': (False, False, V.INDETERMINATE, None, "non-numeric confidence: None"),
    '{"call": "indeterminate", "confidence": "NaN"}': (False, False, V.INDETERMINATE, None, "non-finite confidence"),
    '{"call": "indeterminate", "confidence": "0.7"}': (True, False, V.INDETERMINATE, 0.7, None),
    'Here is my call:\n```\n{"call": "indeterminate", "confidence": 0.3}\n```\nDone.': (True, False, V.INDETERMINATE, 0.3, None),
    f"```JSON\n{GOOD}\n```": (True, True, V.PRESENT, 0.82, None),
    f"I think {{so}} and {{\"a\": }} but: {GOOD} ok": (True, True, V.PRESENT, 0.82, None),
    '{"observed": "a \\"quoted\\" } brace", "call": "indeterminate", "confidence": 0.5, "rationale": "{"}': (True, True, V.INDETERMINATE, 0.5, None),
    'prefix {"note": {"call": "x"}, "call": "indeterminate", "confidence": 0.5} suffix': (True, False, V.INDETERMINATE, 0.5, None),
    "": (False, False, None, None, "empty response"),
    "   ": (False, False, None, None, "empty response"),
    "a refusal in prose": (False, False, None, None, "no JSON object"),
    "[1, 2]": (False, False, None, None, "no JSON object"),
    "{'call': 'indeterminate'}": (False, False, None, None, "no JSON object"),
}


def test_adjudications(make):
    df = make("i int, raw_response string", list(enumerate(CASES)) + [(99, None)])
    out = {r.i: r for r in R.parse_adjudications(df).collect()}
    for i, (text, (ok, full, call, conf, error)) in enumerate(CASES.items()):
        r = out[i]
        assert (r.parsed_ok, r.schema_complete, r.call, r.confidence) == (ok, full, call, pytest.approx(conf) if conf is not None else None), text
        assert (r.parse_error is None) if error is None else (error in r.parse_error), text
    assert out[99].parse_error == "empty response"
    assert out[0].observed == "deep dip" and out[0].rationale == "clear"
    assert out[5].rationale == "x" and out[15].observed == 'a "quoted" } brace'


def test_extractions(make):
    texts = [
        '{"phenotype": "septic shock", "vasopressor_use": true, "shock_state": "vasodilatory", "notes": "on drips"}',
        '```json\n{"phenotype": "stable", "vasopressor_use": false}\n```', 'Sure: {"phenotype": "x"} hope that helps!',
        '{"phenotype": "none", "vasopressor_use": "unknown", "shock_state": ""}', "no json here", "", '{"vasopressor_use": "Y"}']
    out = {r.i: r for r in R.parse_extractions(make("i int, raw_response string", list(enumerate(texts)))).collect()}
    got = {i: (r.parsed_ok, r.phenotype, r.vasopressor_use, r.shock_state, r.notes) for i, r in out.items()}
    assert got == {
        0: (True, "septic shock", True, "vasodilatory", "on drips"), 1: (True, "stable", False, None, None), 2: (True, "x", None, None, None),
        3: (True, None, None, None, None), 4: (False, None, None, None, None), 5: (False, None, None, None, None), 6: (True, None, True, None, None)}
