"""Turns of transcripts that arrive line by line. An addition: the batch operators define the results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.speakers import inline_speaker

OUT = "transcript_id long, turn_no int, speaker string, speaker_kind string, n_lines int, text string"
STATE = "turn_no int, speaker string, speaker_kind string, n_lines int, text string"


def closed_turns(lines: DataFrame) -> DataFrame:
    """Emits a turn once another speaker follows. lines: a stream of (transcript_id, ord, speaker, speaker_kind, text).

    Lines of a transcript must not arrive later than lines with a higher ord in an earlier batch. The last turn of a
    transcript stays open; a line with a null ord is left out.
    """
    def step(key, frames, state):
        import pandas as pd

        now = list(state.get) if state.exists else None
        done = []
        rows = pd.concat(list(frames))
        for r in rows.dropna(subset=["ord"]).sort_values("ord").itertuples(index=False):
            said = (r.text or "").strip()
            if now is not None and (now[1], now[2]) == (r.speaker, r.speaker_kind):
                now[3] += 1
                now[4] = f"{now[4]} {said}".strip()
                continue
            if now is not None:
                done.append((key[0], now[0], now[1] or "UNKNOWN", *now[2:]))
            now = [now[0] + 1 if now else 1, r.speaker, r.speaker_kind, 1, said]
        if now is not None:
            state.update(tuple(now))
        yield pd.DataFrame(done, columns=["transcript_id", "turn_no", "speaker", "speaker_kind", "n_lines", "text"])

    return lines.groupBy("transcript_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


WAITING = "waiting string, last_ms long, label string, kind string, turn_no int, speaker string, speaker_kind string, n_lines int, text string"


def arriving_turns(lines: DataFrame, late: str = "10 minutes", quiet: str = "30 minutes") -> DataFrame:
    """Turns of lines that arrive in any order, speakers carried forward. lines: a stream of (transcript_id, ord, at, cue, text).

    A line waits until the watermark, which stands `late` behind the newest line, has passed its time; then all lines before it are there, and
    lines are taken in order. A transcript from which nothing has come for `quiet` is at its end: its last turn closes. Lines
    that are later than `late` are left out, like those without an ord or a time. Of each transcript the lines of the last
    `late` are held, and one open turn.
    """
    blank = F.expr("trim(coalesce(text, '')) = '' and cue is null")
    x = lines.filter("ord is not null and at is not null").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("own", inline_speaker("text"))
    own = F.expr("own.kind <> 'UNKNOWN' and own.label <> ''")
    x = x.withColumns({
        "blank": blank, "label": F.when(blank, None).when(F.col("cue").isNotNull(), F.col("cue")).when(own, F.col("own.label")), "kind": F.when(blank, None).when(F.col("cue").isNotNull(), F.col("cue")).when(own, F.col("own.kind")),
        "said": F.trim(F.when(blank | F.col("cue").isNotNull() | (F.col("own.rest") == ""), F.col("text")).otherwise(F.col("own.rest")))})
    quiet_ms = int(lines.sparkSession.sql(f"select cast(unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {quiet}) as bigint)").first()[0])

    def step(key, frames, state):
        import pandas as pd

        waiting, last, label, kind, *now = state.get if state.exists else ("[]", 0, None, None, 0, None, None, 0, "")
        waiting = json.loads(waiting)
        for f in frames:
            for r in f.itertuples(index=False):
                ms = r.at.value // 1_000_000
                last = max(last, ms)
                waiting.append([ms, int(r.ord), bool(r.blank), r.label, r.kind, r.said])
        passed, done = state.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda w: (w[0], w[1]))
        ready = [w for w in waiting if w[0] <= passed]
        waiting = waiting[len(ready):]
        close = lambda: done.append((key[0], now[0], now[1] or "UNKNOWN", *now[2:]))
        for _, _, is_blank, own_label, own_kind, said in ready:
            if own_label is not None:
                label, kind = own_label, own_kind
            who = ("", "UNKNOWN") if is_blank else (label or "UNKNOWN", kind or "UNKNOWN")
            if now[0] and (now[1], now[2]) == who:
                now[3], now[4] = now[3] + 1, f"{now[4]} {said}".strip()
            else:
                if now[0]:
                    close()
                now = [now[0] + 1, *who, 1, said]
        if state.hasTimedOut and not waiting and passed >= last + quiet_ms:
            if now[0]:
                close()
            state.remove()
        else:
            state.update((json.dumps(waiting), last, label, kind, *now))
            state.setTimeoutTimestamp(max(passed + 1, waiting[0][0] if waiting else last + quiet_ms))
        yield pd.DataFrame(done, columns=["transcript_id", "turn_no", "speaker", "speaker_kind", "n_lines", "text"])

    x = x.withWatermark("at", late).select("transcript_id", "ord", "at", "blank", "label", "kind", "said")
    return x.groupBy("transcript_id").applyInPandasWithState(step, OUT, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
