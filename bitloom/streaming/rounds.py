"""Review rounds as a stream: one state per project, whatever batches its rounds arrive in.

The session needs a state store that keeps typed state (``spark.sql.streaming.stateStore.providerClass``: RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.history import BLOCKING, UNRESOLVED

HISTORY = "array<struct<finding_id: string, resolution_note: string, severity: string, status: string>>"
_STATE = "review_round int, status string, finding_ids array<string>, blocking_ids array<string>, digest string"


def _refused(before: Row | None, history: list[dict], digest: str) -> str | None:
    """Why a round may not follow the certified one, or null; the rules of :func:`..operators.release.next_rounds` for certificates that are sound."""
    if before is None:
        return None
    now = {f["finding_id"]: f for f in history}
    if any(i not in now for i in before.finding_ids):
        return "finding lost"
    blockers = [now.get(i) for i in before.blocking_ids]
    if any(f is None or f["severity"] not in BLOCKING for f in blockers):
        return "blocker lost or downgraded"
    if before.status == "needs_human":
        if digest == before.digest:
            return "nothing recorded"
        if any(f["severity"] in BLOCKING and f["status"] in UNRESOLVED for f in history):
            return "still blocked"
        if any(f["status"] not in ("resolved", "rejected") for f in blockers):
            return "not settled"
        if any(not (f["resolution_note"] or "").strip() for f in blockers):
            return "no note"
    return None


class Rounds(StatefulProcessor):
    """Keeps the last certificate of a project and certifies, or refuses, each round that arrives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("certificate", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        before = Row(*(f.split()[0] for f in _STATE.split(", ")))(*self.last.get()) if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r.seq):
            history = [f if isinstance(f, dict) else f.asDict() for f in r.history or []]
            problem = _refused(before, history, r.digest)
            number = status = None
            if problem is None:
                ids = [f["finding_id"] for f in history]
                open_ = [f["finding_id"] for f in history if f["severity"] in BLOCKING and f["status"] in UNRESOLVED]
                number = before.review_round + 1 if before else 1
                status = "clear" if not open_ else "needs_human" if before and before.status in ("blocking", "needs_human") else "blocking"
                before = Row(review_round=number, status=status, finding_ids=ids, blocking_ids=open_, digest=r.digest)
            yield Row(project=key[0], seq=r.seq, review_round=number, status=status, problem=problem)
        if before is not None:
            self.last.update(tuple(before))

    def close(self) -> None:
        pass


def certified_rounds(rounds: DataFrame) -> DataFrame:
    """project, seq, review_round, status, problem of a stream of rounds (project string, seq long, history: all findings, in order).

    A refused round changes nothing. Rounds of a project are taken in order of ``seq`` within a batch; batches come in their order.
    """
    lines = F.transform("history", lambda f: F.to_json(f, {"ignoreNullFields": "false"}))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256)
    keyed = rounds.select("project", "seq", F.col("history").cast(HISTORY).alias("history"), digest.alias("digest")).groupBy("project")
    return keyed.transformWithState(Rounds(), "project string, seq long, review_round int, status string, problem string", "Append", "None")
