"""Answer contracts, gap labels and error tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def no_error(error) -> Column:
    """True where the error text is missing or empty."""
    return F.length(F.coalesce(_col(error).cast("string"), F.lit(""))) == 0


def gap_label(gap, tolerance: float = 1.0) -> Column:
    gap = _col(gap)
    return (
        F.when(gap.isNull(), "n/a").when(gap > tolerance, "high").when(gap < -tolerance, "low").otherwise("ok")
    )


def _violations(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def label_violations(label, other_label, labels) -> Column:
    """Names of the rules a classification answer breaks."""
    label, other = _col(label), _col(other_label)
    return _violations(
        ("label_missing", label.isNull()),
        ("label_unknown", ~label.isin(*labels)),
        ("other_label_without_other", (label != "other") & other.isNotNull()),
    )


def score_violations(is_room, score, top_level: Column) -> Column:
    """Rules of a scoring answer: a whole score in 1..top exactly when the photo shows the room."""
    is_room, score = _col(is_room), _col(score)
    return _violations(
        ("room_flag_missing", is_room.isNull()),
        ("score_missing", is_room & score.isNull()),
        ("score_for_other_room", ~is_room & score.isNotNull()),
        ("score_out_of_range", (score < 1) | (score > top_level)),
        ("score_not_whole", score != F.floor(score)),
    )


def level_violations(score, level, room, judged_room, top_level: Column, labels, whole_score_rooms=("living_room",)) -> Column:
    """Rules of a replicate answer: a level on the room's scale, a judged label from the set."""
    score, level, room, judged = _col(score), _col(level), _col(room), _col(judged_room)
    return _violations(
        ("score_missing", score.isNull()),
        ("level_out_of_range", level.isNull() | (level < 1) | (level > top_level)),
        ("label_unknown", judged.isNull() | ~judged.isin(*labels)),
        (
            "score_not_a_level",
            room.isin(*whole_score_rooms) & ((score != F.floor(score)) | (score < 1) | (score > top_level)),
        ),
    )
