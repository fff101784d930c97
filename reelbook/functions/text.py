"""Text, time and path expressions. All are built-in column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelbook import constants as C


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mmss(seconds: Column | str) -> Column:
    """Seconds as ``mm:ss``; minutes are not wrapped at 60 and keep three digits from 100 on."""
    whole = _c(seconds).try_cast("double").cast("bigint")
    minutes = F.floor(whole / 60).cast("bigint")
    text = minutes.cast("string")
    padded = F.when(minutes < 100, F.lpad(text, 2, "0")).otherwise(text)
    return F.concat(padded, F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


@cache
def _folds() -> dict[str, str]:
    """Characters below 0x10000 with their compatibility form in ASCII, several letters for ligatures, fractions and the like."""
    found = {}
    for point in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        folded = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if folded:
            found[chr(point)] = folded
    return found


@cache
def _fold_tables() -> tuple[str, list[tuple[str, str]]]:
    """Characters that become several letters; per place of a letter, all characters and the letters they have there."""
    folds = sorted(_folds().items(), key=lambda x: -len(x[1]))
    tables = []
    for i in range(len(folds[0][1])):
        # Those without a letter at this place stand last, where they are mapped to nothing.
        long = [(c, f[i]) for c, f in folds if len(f) > i]
        none = "".join(c for c, f in folds if 1 < len(f) <= i)
        tables.append(("".join(c for c, _ in long) + none, "".join(f for _, f in long)))
    return "".join(c for c, f in folds if len(f) > 1), tables


def ascii_folded(text: Column | str) -> Column:
    """Text with every character below 0x10000 replaced by its compatibility form; what then is not ASCII is dropped."""
    text = _c(text)
    several, tables = _fold_tables()
    members = F.lit(several)

    def spelled(c: Column) -> Column:
        return F.when(F.instr(members, c) > 0, F.concat(*[F.translate(c, *t) for t in tables])).otherwise(F.translate(c, *tables[0]))

    # Nearly all texts are ASCII already, and nearly all others have accents only: those are folded as a whole.
    letters = F.array_join(F.transform(F.split(text, ""), spelled), "")
    one_each = F.length(F.translate(text, several, "")) == F.length(text)
    folded = F.when(one_each, F.translate(text, *tables[0])).otherwise(letters)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))


def slugify(text: Column | str) -> Column:
    """Lower-case ASCII slug; characters with a compatibility form, such as accents, ligatures and fractions, are spelled out."""
    kept = F.regexp_replace(F.lower(ascii_folded(text)), r"[^a-z0-9_\s\x1c-\x1f-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s\x1c-\x1f]+", "-"), r"^[-_]+|[-_]+$", "")


def drop_ext4(text: Column | str) -> Column:
    """Text without its last four characters, whatever they are."""
    text = _c(text)
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - 4, F.lit(0)))


def stem(text: Column | str) -> Column:
    """Text before the first dot."""
    return F.substring_index(_c(text), ".", 1)


def video_title(team1: Column | str, team2: Column | str, tournament: Column | str, *, name: Column | str | None = None,
                suffix: str = C.TITLE_SUFFIX) -> Column:
    """``T1 vs T2 | TOURNAMENT [TAG]``; with ``name`` the form used at creation, which starts with the file name."""
    teams = F.concat(_c(team1), F.lit(" vs "), _c(team2))
    if name is not None:
        teams = F.concat(_c(name), F.lit(" vs "), teams)
    return F.concat(teams, F.lit(" | "), F.upper(_c(tournament)), F.lit(f" {suffix}"))


def chapter_line(start: Column | str, number: Column | str) -> Column:
    """``mm:ss Point i``."""
    return F.concat(mmss(start), F.lit(" Point "), _c(number).cast("string"))


def default_publication(as_of: Column) -> Column:
    """The evening (18:00) before ``as_of``."""
    return F.date_sub(as_of.cast("date"), 1).cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")


def wall_time(text: Column | str) -> Column:
    """ISO text to its wall time; an offset is read past, not applied."""
    return F.to_timestamp_ntz(F.substring(_c(text), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def effective_date(publish_at: Column | str, published_at: Column | str) -> Column:
    """Planned publication if there is one, else the actual one."""
    return wall_time(F.coalesce(_c(publish_at), _c(published_at)))


def item_video_id(kind: Column | str, item_id: Column | str, resource_video_id: Column | str) -> Column:
    """Video id of an online item; playlist entries carry it one level deeper."""
    return F.when(_c(kind) == C.VIDEO_KIND, _c(item_id)).otherwise(_c(resource_video_id))


def format_pub_date(ts: Column | str) -> Column:
    """``yyyy-MM-ddTHH:mm``."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm")


def _with_fraction(ts: Column | str, zone: str) -> Column:
    """ISO text of a timestamp; six digits of a second follow only where it has a fraction."""
    whole, fraction = F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(_c(ts), ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit(zone))


def iso_utc(ts: Column | str) -> Column:
    """Timestamp as ISO text in UTC."""
    return _with_fraction(ts, "Z")


def publish_schedule(status: Column | str, date: Column | str, as_of: Column) -> Column:
    """Status part of a publish body; null unless a hidden video is due in the future."""
    due = _c(status).isin(C.PRIVATE, C.UNLISTED) & (_c(date) > as_of)
    stamp = _with_fraction(date, "+00:00")
    return F.when(due, F.struct(F.lit(C.PRIVATE).alias("privacyStatus"), stamp.alias("publishAt")))


#: Status labels in branch order; a label is kept as its index while it is aggregated.
STATUS_LABELS = [C.PUBLIC, C.UNLISTED, C.SCHEDULED, C.PRIVATE]


def status_code(status: Column | str, date: Column | str, as_of: Column) -> Column:
    """Index into :data:`STATUS_LABELS`."""
    status = _c(status)
    return (
        F.when(status == C.PUBLIC, 0)
        .when(status == C.UNLISTED, 1)
        .when((status == C.PRIVATE) & (_c(date) >= as_of), 2)
        .otherwise(3)
    )


def label_of(code: Column | str) -> Column:
    """Label of a status index."""
    return F.try_element_at(F.array(*map(F.lit, STATUS_LABELS)), _c(code) + 1)


def status_label(status: Column | str, date: Column | str, as_of: Column) -> Column:
    """Publication state shown for an online video."""
    return label_of(status_code(status, date, as_of))


def thumbnail_key(slug: Column | str, name: Column | str, time_code: Column | str) -> Column:
    """Common stem of a recording's image names, with the whole time code."""
    return F.concat_ws("_", _c(slug), slugify(drop_ext4(name)), _c(time_code).cast("string"))


def path_join(*parts: Column | str) -> Column:
    """Path from a directory, sub-directories (plain strings are literals) and a name."""
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def rendered_path(source_dir: Column | str, name: Column | str | None = None) -> Column:
    """Folder of finished recordings, or a file in it."""
    return path_join(_c(source_dir), C.RENDERED_DIR, *([] if name is None else [_c(name)]))


def timelines_path(source_dir: Column | str) -> Column:
    """Folder of timelines."""
    return path_join(_c(source_dir), C.TIMELINES_DIR)


def rushs_path(source_dir: Column | str) -> Column:
    """Folder of camera files."""
    return path_join(_c(source_dir), C.RUSHS_DIR)


def part_file_name(part: Column | str, key: Column | str) -> Column:
    """Camera file name of one part of a recording."""
    return F.format_string(C.PART_FORMAT, _c(part).cast("int"), _c(key).cast("int"))


def draw_time_code(*natural_key: Column | str) -> Column:
    """Pseudo-random fraction in [0, 1) fixed by the natural key, so a retry draws the same."""
    text = F.concat_ws("\u0001", *[_c(k).cast("string") for k in natural_key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))


def ci_contains(text: Column | str, pattern: Column | str) -> Column:
    """Case-insensitive substring test with a column as pattern; no character is special."""
    return F.contains(F.lower(_c(text)), F.lower(_c(pattern)))
