"""Session logs of simulated writers, with the text that each ends with."""

import json
import random


def session(rng: random.Random, requests: int) -> tuple[list[dict], str]:
    """Events in order and the final text: typing, requests that are accepted, edited, dismissed, selected twice or never shown."""
    text, events, clock = "Start. ", [], [1000]

    def log(name: str, source: str, ops: list | None = None, **more: object) -> None:
        clock[0] += rng.randrange(200, 9000)
        events.append({"eventNum": len(events), "eventName": name, "eventSource": source, "eventTimestamp": clock[0], "textDelta": {"ops": ops} if ops else "", "currentDoc": "", **more})

    def put(at: int, piece: str, source: str) -> None:
        nonlocal text
        log("text-insert", source, [{"retain": at}, {"insert": piece}] if at else [{"insert": piece}])
        text = text[:at] + piece + text[at:]

    def cut(at: int, n: int) -> None:
        nonlocal text
        log("text-delete", "user", [{"retain": at}, {"delete": n}] if at else [{"delete": n}])
        text = text[:at] + text[at + n :]

    log("system-initialize", "api", currentDoc=text)
    events[-1]["currentDoc"] = text
    for _ in range(requests):
        put(len(text), "".join(rng.choice("abcde ") for _ in range(rng.randrange(3, 30))), "user")
        log("suggestion-get", "user")
        kind = rng.choice(["accept", "accept", "edit", "edit", "gone", "dismiss", "none", "ignored", "twice"])
        if kind == "none":
            continue
        shown = [{"index": i, "original": f" {w} ", "trimmed": w, "probability": 0.5} for i, w in enumerate(rng.sample(["one two three", "four five", "six seven eight nine", "ten"], 3))]
        log("suggestion-open", "api", currentSuggestions=shown)
        if kind == "dismiss":
            log("suggestion-close", "user")
            continue
        if kind == "ignored":
            continue
        for _ in range(2 if kind == "twice" else 1):
            at = rng.randrange(3)
            log("suggestion-select", "user", currentHoverIndex=at)
            place = len(text)
            put(place, shown[at]["trimmed"], "api")
        log("suggestion-close", "api")
        if rng.random() < 0.2:
            log("suggestion-reopen", "user")
            log("suggestion-close", "user")
        size = len(shown[at]["trimmed"])
        if kind == "edit":
            put(place + 1, "X", "user")
            cut(place + 2, 1)
        elif kind == "gone":
            cut(place, size)
        if rng.random() < 0.5:
            put(len(text), ". ", "user")
    return events, text


def write(folder, sessions: int, seed: int = 5) -> dict[str, str]:
    """A log file per session; returns the final text of each."""
    rng, out = random.Random(seed), {}
    for k in range(sessions):
        events, text = session(rng, rng.randrange(0, 9) if k else 0)
        (folder / f"s{k:03d}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
        out[f"s{k:03d}"] = text
    return out
