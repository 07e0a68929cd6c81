"""Column functions on paths, tokens, transcripts and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that mean silence; any other <tag> does too.
SILENCE = ["", "<silence:>", "<silence>", "<pause>", "<p:>", "sil", "sp"]
# Line patterns of subtitle files.
CUE_TIMES = r"^(\d{2}:\d{2}:\d{2},\d{3})\s+-->\s+(\d{2}:\d{2}:\d{2},\d{3})"
TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
# What ends a line, what is white space at the ends of a text, and what a spoken word is made of.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITE = r"[\s\x1c-\x1f]"
SPOKEN = "0-9A-Za-zА-Яа-яЁё"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"(?U)^{WHITE}+|{WHITE}+\z", "")


def lines(text: Column) -> Column:
    return F.split(text, LINE_ENDS)


def normalize_path(path: Column, marker: str = "ru_dataset/", prefix: str = "02_model_inputs/") -> Column:
    """Without blanks and quotes, with forward slashes, from after the first marker on, without the prefix and leading dots and slashes."""
    plain = strip(path)
    for quote in ('"', "'"):
        plain = F.regexp_replace(plain, f"^{quote}+|{quote}+$", "")
    plain = F.translate(plain, "\\", "/")
    at = F.instr(plain, marker)
    plain = F.when(at > 0, F.substring(plain, at + len(marker), F.length(plain))).otherwise(plain)
    plain = F.when(plain.startswith(prefix), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)
    return F.regexp_replace(plain, r"^[./]+", "")


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"(.)\.[^.]*$", "$1")


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path_name(path), r".(\.[^.]*)$", 1))


def path_parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def sanitize_path_part(part: Column) -> Column:
    """A name that any file system takes."""
    clean = F.regexp_replace(F.regexp_replace(part, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(clean == "", "_").otherwise(clean)


def video_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path_stem(path), r"^yt_", ""), r"\.sub$", "")


def normalize_token(token: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(token), "ё", "е"), r"[^0-9a-zа-я\-]+", "")


def clean_transcript(text: Column) -> Column:
    """Spoken words of a subtitle or transcript text in lower case: no headers, times, numbers on lines of their own, tags or other symbols."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: ~((x == "") | F.upper(x).startswith("WEBVTT") | x.rlike(rf"^{TIME}\s*-->\s*{TIME}$") | x.rlike(r"^\d+$")))
    merged = F.array_join(kept, " ")
    for pattern in (r"<[^>]+>", r"\[[^\]]+\]", rf"[^{SPOKEN}\- ]+"):
        merged = F.regexp_replace(merged, pattern, " ")
    return F.lower(F.trim(F.regexp_replace(merged, " +", " ")))


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def parse_srt_time(value: Column) -> Column:
    """Seconds of HH:MM:SS,mmm."""
    part = lambda k: F.regexp_extract(value, r"^(\d+):(\d+):(\d+),(\d+)$", k).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def media_duration(probe: Column) -> Column:
    """Seconds of a ``Duration: H:M:S.f`` entry; null if there is none or it is not positive."""
    part = lambda k: F.regexp_extract(probe, r"Duration:\s*(\d+):(\d+):(\d+(?:\.\d+)?)", k)
    seconds = F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))
    return F.when(seconds > 0, seconds)


def media_fps(probe: Column) -> Column:
    found = F.regexp_extract(probe, r"(\d+(?:\.\d+)?)\s+fps", 1)
    fps = F.when(found != "", found.cast("double"))
    return F.when(fps > 0, fps)


def media_valid(probe: Column) -> Column:
    """Whether a probe names both a length and a frame rate that are positive; a medium without either is rejected."""
    return media_duration(probe).isNotNull() & media_fps(probe).isNotNull()


def is_silence(label: Column) -> Column:
    plain = F.lower(strip(label))
    return plain.isin(SILENCE) | plain.rlike(r"(?s)^<.*>$")


def detect_source(name: Column, default: str = "unknown") -> Column:
    plain = F.lower(name)
    return F.when(plain.startswith("yt_") | plain.contains("youtube"), "youtube").when(plain.startswith("self_"), "self_recorded").otherwise(default)


def clip_path(root: str, word: Column, speaker: Column, stem: Column, number: Column) -> Column:
    """root/word/speaker/stem_number.mp4: six digits at least, the word as a safe name."""
    return F.concat_ws("/", F.lit(root), sanitize_path_part(word), speaker, F.concat(stem, F.format_string("_%06d.mp4", number)))


def unsafe_path(path: Column) -> Column:
    """An absolute path, or one that goes up."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
