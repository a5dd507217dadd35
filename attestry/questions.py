"""The questions put to a model about one test: one choice of a primary type, one yes-or-no question per trait
that no parser rule establishes. Identifiers and types are fixed; the wording is this project's own."""

from __future__ import annotations

import json

from attestry import taxonomy as X

PRIMARY_QUESTION = "primary_type"

#: type -> (what it is, what it is not, examples)
PRIMARY = {
    "unit": ("Runs a small part of the code inside its own process; whatever lies outside is left out or stands in as a double.", ["Anything that opens a real file, socket, database or process."], ["Feeds a parser a string and compares the tree."]),
    "integration": ("Crosses a real boundary once (database, file system, network, process, framework) or wires several production parts together.", ["A lone function that touches nothing outside."], ["Stores a row and reads it back.", "Starts a framework context and calls a bean."]),
    "contract": ("Holds two sides that are developed apart to a shared schema, protocol or format.", ["Checks of the code against itself that nobody else relies on."], ["Replays a consumer's published expectations against the provider."]),
    "end_to_end": ("Walks through a whole workflow from a public entry point to the real systems behind it.", ["One boundary looked at alone."], ["Submits a purchase over the public interface and finds the shipment."]),
    "performance": ("Is there to measure time, throughput, memory, load or a like quantity.", ["A check of results that only happens to be quick."], ["A benchmark that counts allocations."]),
    "smoke": ("Only looks whether something starts or answers at all.", ["Any closer look at what it does."], ["Calls the health endpoint after the start."]),
    "other": ("Plainly a test, of a kind that no other entry describes.", [], []),
    "unknown": ("What is shown does not suffice to tell.", [], []),
}
#: trait -> (question, when it holds, when it does not, what is meant to be left out)
ASKED = {
    "property": ("Does the test state something that must hold for many generated or varied inputs?", "A law or invariant is checked over inputs that are generated or varied.", "Only examples written down one by one are checked.", ""),
    "regression": ("Was the test written to keep a defect that was once observed from coming back?", "A certain past defect or its repair is named or plainly meant.", "No past defect can be recognised.", "Tests of new behaviour, and edge cases in general."),
    "database": ("Does the test talk to a real database engine?", "A database engine, through its driver or schema, takes part.", "No database takes part, or only a substitute in memory.", "Repositories replaced by doubles."),
    "filesystem": ("Does the test read or write the real file system?", "Real files or directories are read, written or inspected.", "No file system is touched.", "Data compiled into the program, file systems in memory."),
    "network": ("Does the test cross a real network boundary?", "A server, socket, name service or peer outside the process answers.", "Nothing leaves the process.", "Test servers inside the process, recorded answers, doubles."),
    "containerized": ("Does the test start a container or need one that is orchestrated for it?", "A container or orchestrated workload is part of the test.", "No container is involved.", "Plain local processes and servers in the process."),
    "time_sensitive": ("Can clocks, delays, sleeps or the order of scheduling decide the outcome?", "The outcome rests on timing.", "Timing does not matter for the outcome.", ""),
}


def question_id(trait: str) -> str:
    return f"trait_{trait}"


def question_set(asked: tuple[str, ...] = X.ASKED) -> dict[str, dict]:
    """Question id -> question: type, instructions, criteria. A trait without a question is not asked."""
    kinds = {}
    for name, (what, not_for, examples) in PRIMARY.items():
        kinds[name] = {"what": what} | ({"not_for": not_for} if not_for else {}) | ({"examples": examples} if examples else {})
    out = {PRIMARY_QUESTION: {"type": "choice", "instructions": "Name the type of the test by the widest real boundary it crosses while it runs; how it is written does not count.", "criteria": kinds}}
    for t in asked:
        if t in ASKED:
            question, holds, fails, left_out = ASKED[t]
            told = {"question": question, "not_for": left_out} if left_out else question
            out[question_id(t)] = {"type": "noul", "instructions": told, "criteria": {"true": holds, "false": fails}}
    return out


def questions_json(asked: tuple[str, ...] = X.ASKED) -> str:
    return json.dumps(question_set(asked), separators=(",", ":"))
