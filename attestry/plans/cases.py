"""Stored model answers with the error each must have, written down by hand: the case tables of queries and tests."""

from __future__ import annotations

_NOULS = (
    '"trait_property":{"type":"noul","noul":0.61},"trait_regression":{"type":"noul","noul":0.12},"trait_database":{"type":"noul","noul":0.5},"trait_filesystem":{"type":"noul","noul":0.49},'
    '"trait_network":{"type":"noul","noul":1},"trait_containerized":{"type":"noul","noul":0},"trait_time_sensitive":{"type":"noul","noul":0.07}'
)
_PRIMARY = '"primary_type":{"type":"choice","choice":"smoke","probabilities":{"smoke":0.7,"unit":0.3},"confidence":0.82}'
GOOD = '{"model":"m-1","answers":{' + _PRIMARY + "," + _NOULS + '},"usage":{"input_tokens":812,"output_tokens":64}}'


def _with(old: str, new: str) -> str:
    assert old in GOOD
    return GOOD.replace(old, new)


#: (response, error or None)
RESPONSES: tuple[tuple[str | None, str | None], ...] = (
    (GOOD, None),
    (_with('"probabilities":{"smoke":0.7,"unit":0.3},"confidence":0.82', '"probabilities":{"unit":0.34,"smoke":0.33,"other":0.33},"confidence":0.02'), None),
    (_with('"model":"m-1"', '"MODEL":"m-1"'), None),
    ('{"model":"m-1","answers":', "invalid JSON"),
    (GOOD + " {}", "invalid JSON"),
    (_with('"confidence":0.82', '"confidence":NaN'), "invalid JSON"),
    (_with('"confidence":0.82', '"confidence":"0.82"'), "invalid JSON"),
    ('["m-1"]', "invalid JSON"),
    (None, "invalid JSON"),
    (_with('"model":"m-1"', '"model":""'), "missing model"),
    (_with('"model":"m-1",', ""), "missing model"),
    ('{"model":"m-1"}', "missing answers"),
    ('{"model":"m-1","answers":{}}', "missing answers"),
    (_with(_PRIMARY + ",", ""), "missing primary answer"),
    (_with('"type":"choice"', '"type":"noul"'), "primary answer type"),
    (_with('"choice":"smoke"', '"choice":"sanity"'), "unknown primary type"),
    (_with('"probabilities":{"smoke":0.7,"unit":0.3},', ""), "no probabilities"),
    (_with(',"confidence":0.82', ""), "no confidence"),
    (_with('"confidence":0.82', '"confidence":1.2'), "confidence out of range"),
    (_with('"unit":0.3', '"sanity":0.3'), "unknown probability label"),
    (_with('{"smoke":0.7,"unit":0.3}', '{"smoke":1.2,"unit":-0.2}'), "probability out of range"),
    (_with('"unit":0.3', '"unit":0.2'), "probability sum"),
    (_with('{"smoke":0.7,"unit":0.3}', '{"other":0.7,"unit":0.3}'), "choice not in probabilities"),
    (_with(',"trait_network":{"type":"noul","noul":1}', ""), "trait network missing"),
    (_with('"trait_database":{"type":"noul","noul":0.5}', '"trait_database":{"type":"choice","choice":"unit"}'), "trait database type"),
    (_with('"trait_property":{"type":"noul","noul":0.61}', '"trait_property":{"type":"noul"}'), "trait property no value"),
    (_with('"noul":0.12', '"noul":1.5'), "trait regression out of range"),
)
