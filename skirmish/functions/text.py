"""Column functions on names, tags, spell names and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of damage tags.
MOD_BITS = {
    "Critical": 1,
    "Twincast": 2,
    "Lucky": 4,
    "Flurry": 8,
    "Riposte": 16,
    "Strikethrough": 32,
    "Finishing_Blow": 64,
    "Double_Bow_Shot": 128,
    "Rampage": 256,
    "Wild_Rampage": 512,
    "Headshot": 1024,
    "Assassinate": 2048,
    "Slay_Undead": 4096,
    "Locked": 8192,
}
# Which words of a tag stand for which mods, by the kind of event.
MOD_WORDS = {
    "hit": {
        "critical": ["Critical"],
        "crippling": ["Critical"],
        "twincast": ["Twincast"],
        "twinstrike": ["Twincast"],
        "lucky": ["Lucky"],
        "riposte": ["Riposte"],
        "strikethrough": ["Strikethrough"],
        "flurry": ["Flurry"],
        "finishing": ["Finishing_Blow"],
        "doublebow": ["Double_Bow_Shot"],
        "headshot": ["Headshot"],
        "assassinate": ["Assassinate"],
        "slay": ["Slay_Undead", "Critical"],
        "rampage": ["Rampage"],
        "wild": ["Wild_Rampage"],
        "locked": ["Locked"],
    },
    "heal": {"critical": ["Critical"], "twincast": ["Twincast"], "lucky": ["Lucky"]},
    "miss": {"flurry": ["Flurry"], "lucky": ["Lucky"], "riposte": ["Riposte"], "strikethrough": ["Strikethrough"]},
}
# Class names as shown by a who list, and their short forms; bit k of a class mask is the kth class.
CLASSES = {
    "Warrior": "WAR",
    "Cleric": "CLR",
    "Paladin": "PAL",
    "Ranger": "RNG",
    "Shadow Knight": "SHD",
    "Druid": "DRU",
    "Monk": "MNK",
    "Bard": "BRD",
    "Rogue": "ROG",
    "Shaman": "SHM",
    "Necromancer": "NEC",
    "Wizard": "WIZ",
    "Magician": "MAG",
    "Enchanter": "ENC",
    "Beastlord": "BST",
    "Berserker": "BER",
}
PET_NAME = r"^[GJKLVXZ]([aeio][bknrs]){0,2}(ab|er|n|tik)$"


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def fix_name(name: Column, owner: Column) -> Column:
    """A name as written in the log: forms of "you" are the log's owner, a possessive ending goes, the first letter is upper case."""
    plain = F.regexp_replace(name, "'s$", "")
    first = F.substring(plain, 1, 1)
    capital = F.when(first == F.lower(first), F.concat(F.upper(first), F.substring(plain, F.lit(2), F.length(plain)))).otherwise(plain)
    return F.when(F.lower(name).isin("you", "your", "yourself"), owner).when(name != "", capital)


def reflexive(target: Column, source: Column) -> Column:
    return F.when(target.isin("himself", "herself", "itself"), source).otherwise(target)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def parse_mods(tag: Column, kind: str) -> Column:
    """Tag text to a list of mod names, each once; no tag gives an empty list."""
    words = F.split(F.replace(F.lower(tag), F.lit("double bow shot"), F.lit("doublebow")), " ")
    table = _lookup(MOD_WORDS[kind])
    found = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def mod_bits(mods: Column) -> Column:
    table = _lookup(MOD_BITS)
    return F.aggregate(mods, F.lit(0), lambda acc, m: acc.bitwiseOR(F.coalesce(F.try_element_at(table, m), F.lit(0))))


def class_code(name: Column) -> Column:
    return F.try_element_at(_lookup(CLASSES), name)


def class_names(mask: Column) -> Column:
    """Short names in a class mask, joined by commas."""
    bits = F.array(*[F.when(mask.bitwiseAND(1 << k) != 0, F.lit(c)) for k, c in enumerate(CLASSES.values())])
    return F.array_join(bits, ",")


def attack_label(verb: Column, mods: Column) -> Column:
    """The label a hit is counted under: special finishes first, then ripostes, else the verb."""
    out = verb
    for mod, label in (("Riposte", "riposte"), ("Slay_Undead", "slay"), ("Assassinate", "assassinate"), ("Headshot", "headshot"), ("Finishing_Blow", "finishing")):
        out = F.when(F.array_contains(mods, mod), F.lit(label)).otherwise(out)
    return out


def strip_rank(spell: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(spell, r"\s\(?\d+\)?$", ""), r"\s(Rk\.\s)?[IVX]+$", "")


def is_pet_name(name: Column) -> Column:
    return name.rlike(PET_NAME)


def unlikely_click(spell: Column, duration: Column) -> Column:
    """True where a spell's name tells that it was cast, not set off by an item."""
    return spell.startswith("Ancient:") | spell.rlike(r"Rk\.\s?I?II$") | (spell.rlike(r"\s[XVI]{1,4}$") & (duration > 0))


def pet_owner(name: Column) -> Column:
    """The owner that a warder's, ward's, pet's or eye's name tells, or null."""
    ends = F.regexp_extract(name, r"^(.+)['`]s (?:warder|ward|pet)$", 1)
    eye = F.regexp_extract(name, r"^Eye of (.+)$", 1)
    return F.coalesce(empty_to_null(eye), empty_to_null(ends))


def fmt_num(n: Column) -> Column:
    """A number in short form: 1.23B, 4.56M, 78K, 1.2K, 999."""
    return (
        F.when(n >= 1_000_000_000, F.concat(F.format_string("%.2f", n / 1e9), F.lit("B")))
        .when(n >= 1_000_000, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M")))
        .when(n >= 10_000, F.concat(F.format_string("%.0f", n / 1e3), F.lit("K")))
        .when(n > 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def fmt_date(ts: Column, as_of: Column) -> Column:
    """Month and day, with the time in the year of ``as_of`` and with the year in others."""
    return F.when(F.year(ts) == F.year(as_of), F.date_format(ts, "MMM dd HH:mm")).otherwise(F.date_format(ts, "MMM dd  yyyy"))


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.trim(F.substring(text, 1, n - 2)), F.lit(".."))).otherwise(text)
