"""Character provenance by delta replay over runs of equal origin, never one row per character."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Provenance:
    """spans: [origin, selection_id, embed, length, text] in document order."""

    spans: list[list] = field(default_factory=list)
    anomalies: list[str] = field(default_factory=list)
    deleted: dict[str, int] = field(default_factory=dict)
    inserted: dict[str, int] = field(default_factory=dict)

    def _cut(self, place: int) -> int:
        """The number of the span that starts at a place, which is split there if need be."""
        at = 0
        for k, span in enumerate(self.spans):
            if at == place:
                return k
            if place < at + span[3]:
                keep = place - at
                self.spans.insert(k + 1, [span[0], span[1], span[2], span[3] - keep, span[4][keep:]])
                span[3], span[4] = keep, span[4][:keep]
                return k + 1
            at += span[3]
        return len(self.spans)

    @property
    def length(self) -> int:
        return sum(s[3] for s in self.spans)

    def apply(self, ops: list[Any], source: str, selection: str | None) -> None:
        """One delta: each operation may retain, insert and delete, in this order; a bad part skips the rest of its operation."""
        cursor = 0
        for op in ops:
            if not isinstance(op, dict):
                self.anomalies.append("operation is no object")
                continue
            if "retain" in op:
                step = op["retain"]
                if not isinstance(step, int) or isinstance(step, bool) or step < 0:
                    self.anomalies.append("bad retain")
                    continue
                if cursor + step > self.length:
                    self.anomalies.append("retain past the end")
                cursor = min(cursor + step, self.length)
            if "insert" in op:
                piece = op["insert"]
                embed = not isinstance(piece, str)
                api = source == "api" and selection is not None and not embed
                origin = selection if api else "human" if source == "user" else source
                size = 1 if embed else len(piece)
                if size:
                    self.spans.insert(self._cut(cursor), [origin, selection if api else None, embed, size, "￼" if embed else piece])
                    if api:
                        self.inserted[selection] = self.inserted.get(selection, 0) + size
                cursor += size
            if "delete" in op:
                count = op["delete"]
                if not isinstance(count, int) or isinstance(count, bool) or count < 0:
                    self.anomalies.append("bad delete")
                    continue
                end = cursor + count
                if end > self.length:
                    self.anomalies.append("delete past the end")
                    end = self.length
                first, last = self._cut(cursor), self._cut(end)
                for span in self.spans[first:last]:
                    if not span[2]:
                        key = span[1] or span[0]
                        self.deleted[key] = self.deleted.get(key, 0) + span[3]
                del self.spans[first:last]

    def chars(self, rule: Any = lambda s: True) -> int:
        return sum(s[3] for s in self.spans if not s[2] and rule(s))

    def survivors(self, selection: str) -> dict[str, Any]:
        """inserted, surviving, deleted, the span of what survives, foreign units in it and whether it is whole."""
        at, start, end, own = 0, None, None, 0
        for s in self.spans:
            if s[1] == selection:
                start = at if start is None else start
                end = at + s[3]
                own += s[3]
            at += s[3]
        units = 0 if start is None else end - start
        return {"inserted_chars": self.inserted.get(selection, 0), "surviving_chars": own, "deleted_chars": self.deleted.get(selection, 0), "final_span_start": start, "final_span_end": end, "final_span_units": units, "intervening_units": units - own, "survives_contiguously": start is not None and units == own}


def replay_document(events: list[dict[str, Any]], selection_of_insert: dict[int, str]) -> Provenance:
    """events: event_name, event_num, source, current_doc, ops; the first system-initialize gives the first document."""
    out = Provenance()
    begun = next((e for e in events if e["event_name"] == "system-initialize"), None)
    if begun and begun.get("current_doc"):
        out.spans.append(["system", None, False, len(begun["current_doc"]), begun["current_doc"]])
    for e in events:
        if e["event_name"] in ("text-insert", "text-delete") and isinstance(e.get("ops"), list):
            out.apply(e["ops"], e["source"], selection_of_insert.get(e["event_num"]))
    return out
