"""Texts through the extraction job, all in one pass."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from skirmish.operators.lines import rejected_lines, split_lines
from skirmish.operators.messages import compile_template
from skirmish.operators.rules import DEFAULT_RULES, LOCATION, extract_events

OWNER = "Quillon"
# text, kind, expected columns; by rule, the odd ones first
CASES = [
    # melee: the verb that counts is the last one before the target
    ("The bite that slices pierces Oswin for 1 point of damage.", "hit", {"source": "The bite that slices", "type": "pierce", "target": "Oswin", "amount": 1}),
    ("moss golem frenzies on Oswin for 31 points of damage. (Wild Rampage)", "hit", {"source": "Moss golem", "type": "frenzy", "mods": ["Wild_Rampage", "Rampage"]}),
    ("Oswin mauls itself for 18 points of damage.", "hit", {"source": "Oswin", "target": "Oswin", "type": "maul"}),
    ("You frenzy on a moss golem for 640 points of damage. (Slay Undead)", "hit", {"source": OWNER, "type": "frenzy", "mods": ["Slay_Undead", "Critical"]}),
    ("You shoot a moss golem for 12 points of damage. (Flurry Double Bow Shot)", "hit", {"type": "shoot", "mods": ["Flurry", "Double_Bow_Shot"]}),
    ("Oswin punches YOU for 123456789012345678901 points of damage.", "hit", {"target": OWNER, "type": "punch", "amount": None}),
    ("Oswin was hit by non-melee for 3 points of damage.", "raw", {}),
    ("Oswin crushes a moss golem for 5 points of damage", "raw", {}),
    ("Pell hit a moss golem for 88 points of cold damage by Rime Lance IV. (Lucky Critical)", "hit", {"type": "dd", "source": "Pell", "spell": "Rime Lance IV", "mods": ["Lucky", "Critical"]}),
    ("Pell hit Pell for 9 points of non-melee damage.", "hit", {"type": "dd", "target": "Pell", "spell": None}),
    ("moss golem has taken 15 damage from your Slow Rot.", "hit", {"type": "dot", "source": OWNER, "target": "Moss golem", "spell": "Slow Rot"}),
    ("moss golem has taken 4 damage from Bee Sting by Pell. (Twincast)", "hit", {"type": "dot", "source": "Pell", "target": "Moss golem", "mods": ["Twincast"]}),
    ("You have taken 6 damage from Bee Sting by moss golem.", "hit", {"type": "dot", "source": OWNER, "target": "Moss golem"}),
    ("You have taken 6 damage from Bee Sting.", "hit", {"source": None, "target": OWNER, "spell": "Bee Sting"}),
    ("Oswin has taken 2 damage by Old Wounds II.", "hit", {"source": None, "target": "Oswin"}),
    ("YOU are scorched by moss golem's embers for 14 points of non-melee damage!", "hit", {"type": "ds", "source": "Moss golem", "target": OWNER, "mods": None}),
    ("moss golem is stung by YOUR nettles for 1 point of non-melee damage.", "hit", {"type": "ds", "source": OWNER}),
    ("Oswin was chilled to the bone for 70 points of non-melee damage.", "hit", {"type": "ds", "source": "Oswin", "target": "Oswin"}),
    # misses: the type is the last word of what happened
    ("moss golem tries to gore Missy, but Missy dodges!", "miss", {"source": "Moss golem", "target": "Missy", "type": "dodge"}),
    ("You try to frenzy on a moss golem, but miss! (Riposte Strikethrough)", "miss", {"source": OWNER, "target": "A moss golem", "type": "miss", "mods": ["Riposte", "Strikethrough"]}),
    ("moss golem tries to kick YOU, but YOU are INVULNERABLE!", "miss", {"type": "invul", "target": OWNER}),
    ("Oswin tries to bash a moss golem, but a moss golem's magical skin absorbs the blow!", "miss", {"type": "rune"}),
    ("Oswin tries to bash a moss golem, but a moss golem blocks!", "miss", {"type": "block"}),
    ("moss golem tries to bash Oswin, but Oswin blocks with her shield!", "miss", {"type": "shield"}),
    ("Oswin tries to claw a moss golem, but a moss golem parries!", "miss", {"type": "parry"}),
    ("moss golem tries to claw YOU, but YOU riposte!", "miss", {"type": "riposte"}),
    ("Oswin tries to leave, but stays!", "raw", {}),
    ("Oswin tries to sell a moss golem, but laughs!", "raw", {}),
    # heals
    ("Vessa healed herself over time for 3 (50) hit points by Spring Rain. (Critical)", "heal", {"source": "Vessa", "target": "Vessa", "amount": 3, "full_amount": 50, "spell": "Spring Rain", "mods": ["Critical"]}),
    ("You have been healed over time for 7 hit points by Spring Rain.", "heal", {"source": None, "target": OWNER, "amount": 7, "full_amount": 7}),
    ("Vessa`s ward healed you for 20 (30) hit points by Green Ward.", "heal", {"source": "Vessa`s ward", "target": OWNER, "spell": "Green Ward"}),
    ("Vessa healed Oswin for 11 hit points.", "heal", {"full_amount": 11, "spell": None}),
    ("Oswin feels warm. Vessa healed Oswin for 2 (4) hit points by Warm Hands.", "heal", {"source": "Vessa", "target": "Oswin", "full_amount": 4}),
    ("Nibbler has been healed for 1 (2) hit points by Pack Heart.", "heal", {"source": None, "target": "Nibbler", "mods": None}),
    # casts
    ("You begin singing Chant of Tin.", "casting", {"source": OWNER, "type": "Song", "spell": "Chant of Tin"}),
    ("moss golem begins casting Rime Lance.", "casting", {"source": "Moss golem", "type": "Spell"}),
    ("Oswin activates Stone Stance.", "casting", {"type": "Disc", "spell": "Stone Stance"}),
    ("Vessa begins to cast a spell. <Warm Hands>", "casting", {"type": "Spell", "spell": "Warm Hands"}),
    ("Vessa begins to sing a song. <Chant of Tin>", "casting", {"type": "Song"}),
    ("Vessa's Warm Hands spell is interrupted.", "cast_fail", {"source": "Vessa", "spell": "Warm Hands", "type": "interrupt"}),
    ("Your Warm Hands spell is interrupted.", "cast_fail", {"source": OWNER, "type": "interrupt"}),
    ("An old hermit's Miser's Bolt spell fizzles!", "cast_fail", {"source": "An old hermit", "spell": "Miser's Bolt", "type": "fizzle"}),
    ("Your Miser's Bolt spell fizzles!", "cast_fail", {"source": OWNER, "spell": "Miser's Bolt"}),
    # deaths
    ("The one who died died.", "death", {"name": "The one who died", "killshot": None}),
    ("Oswin has been slain by moss golem!", "death", {"name": "Oswin", "killshot": "Moss golem"}),
    ("You have been slain by Pell!", "death", {"name": OWNER, "killshot": "Pell"}),
    ("You have slain moss golem!", "death", {"name": "Moss golem", "killshot": OWNER}),
    # chat
    ("Oswin tells the group, 'it said, 'no''", "chat", {"source": "Oswin", "channel": "group", "message": "it said, 'no'"}),
    ("You tell your party, 'ready'", "chat", {"source": OWNER, "channel": "group"}),
    ("Oswin tells you, in an unknown tongue, 'hm'", "chat", {"channel": "tell", "message": "hm"}),
    ("You told Oswin, 'later'", "chat", {"source": OWNER, "channel": "tell"}),
    ("Oswin tells traders:7, 'nails for sale'", "chat", {"channel": "traders"}),
    ("You say to your guild, 'evening'", "chat", {"channel": "guild"}),
    ("Oswin says out of channel, 'anyone?'", "chat", {"channel": "ooc"}),
    ("Oswin auctions, 'WTS nails'", "chat", {"channel": "auction"}),
    ("You shout, 'over here'", "chat", {"channel": "shout", "source": OWNER}),
    # places, parties, people
    ("You have entered the Salt Mines of Orr.", "zone", {"name": "the Salt Mines of Orr"}),
    ("You have entered an area where Bind Affinity is allowed.", "raw", {}),
    ("You have joined the group.", "party", {"name": OWNER, "status": "GroupJoined"}),
    ("Oswin joined the raid.", "party", {"name": "Oswin", "status": "RaidJoined"}),
    ("Oswin has left the raid.", "party", {"status": "RaidLeft"}),
    ("You have been removed from the group.", "party", {"name": OWNER, "status": "GroupLeft"}),
    ("You remove Pell from the party.", "party", {"name": "Pell", "status": "GroupLeft"}),
    ("* Pell has entered channel traders:7", "party", {"name": "Pell", "status": "ChannelJoined", "channel": None}),
    ("* Pell has left channel traders:7", "party", {"status": "ChannelLeft"}),
    ("[ANONYMOUS] Pell", "who", {"name": "Pell", "level": 0, "class": None}),
    ("  AFK [34 Druid] Vessa (Wood Elf) ZONE: orr", "who", {"name": "Vessa", "level": 34, "class": "DRU"}),
    ("LFG [71 Assassin (Rogue)] Pell (Gnome)", "who", {"name": "Pell", "level": 71, "class": "ROG"}),
    ("Targeted (Player): Vessa", "who", {"name": "Vessa"}),
    ("Targeted (Merchant): Vessa", "raw", {}),
    ("Old Mother Tusk - a rare creature - glowers at you dubiously -- you would need some luck. (Lvl: 44)", "consider", {"name": "Old Mother Tusk", "rare": True, "level": 44, "strength": "you would need some luck."}),
    ("A ferryman judges you amiably -- an even match. (Lvl: 9)", "consider", {"name": "A ferryman", "faction": "judges you amiably", "rare": False}),
    # loot and trade
    ("--You have looted a Bent Nail.--", "loot", {"name": OWNER, "item": "Bent Nail", "qty": 1, "source": None}),
    ("--Pell has looted 14 Bent Nail from moss golem's corpse .--", "loot", {"name": "Pell", "qty": 14, "source": "Moss golem"}),
    ("Pell grabbed a Bent Nail from moss golem's corpse .", "loot", {"name": "Pell", "item": "Bent Nail", "source": "Moss golem"}),
    ("--Pell stole Tin Cup from ferryman!--", "loot", {"item": "Tin Cup", "source": "Ferryman", "qty": 1}),
    ("--Pell stole coin from ferryman!--", "raw", {}),
    ("--You left an Old Boot on moss golem's corpse.--", "rot", {"name": OWNER, "item": "Old Boot", "source": "Moss golem"}),
    ("--3 Old Boot were left on moss golem's corpse.--", "rot", {"name": None, "item": "Old Boot", "source": "Moss golem"}),
    ("You have fashioned the items together to create an alternate product: Tin Whistle.", "craft", {"name": OWNER, "item": "Tin Whistle"}),
    ("You receive 4 gold and 19 copper from the corpse.", "coin", {"platinum": None, "gold": 4, "silver": None, "copper": 19}),
    ("Alive group members received 1 platinum.", "coin", {"platinum": 1}),
    # progress
    ("You gain experience! (1.25%)", "xp", {"type": "SoloXP", "xp": Decimal("1.25")}),
    ("You gained raid experience!", "xp", {"type": "RaidXP", "xp": None}),
    ("You have gained 1 ability point(s)!  You now have 3 ability point(s).", "aaxp", {"amount": 1, "total": 3}),
    ('You have gained the ability "Tin Ear" at a cost of 1 ability point.', "aa_purchase", {"name": "Tin Ear", "cost": 1}),
    ("You have improved Tin Ear 2 at a cost of 8 ability points.", "aa_purchase", {"name": "Tin Ear 2", "cost": 8}),
    ("You have become better at Swimming! (77)", "skill", {"name": "Swimming", "level": 77}),
    # the rest
    ("Vessa begins to use Oswin's corpse as a living shield!", "shield", {"target": "Vessa", "source": "Oswin"}),
    ("You has been rescued by divine intervention!", "rescued", {"target": OWNER}),
    ("Oswin was partially successful in capturing moss golem's attention.", "taunt", {"source": "Oswin", "target": "Moss golem"}),
    ("You capture moss golem's attention with your unparalleled reproach!", "taunt", {"source": OWNER, "target": "Moss golem"}),
    ("Oswin captures the attention of everything in the area!", "taunt", {"source": "Oswin", "target": None}),
    ("**A Magic Die is rolled by Pell. It could have been any number from 5 to 50, but this time it turned up a 5.", "dice", {"source": "Pell", "min": 5, "max": 50, "roll": 5, "item": None}),
    ("Pell rolled a 999 on Bent Nail of Mr. Orr.", "dice", {"min": 1, "max": 1000, "roll": 999, "item": "Bent Nail of Mr. Orr"}),
    ("You are cured of Slow Rot by Vessa.", "cure", {"source": "Vessa", "target": OWNER, "spell": "Slow Rot"}),
    ("Outputfile Complete: Orr_test-20240229-235959.txt", "output_file", {"file_name": "Orr_test-20240229-235959.txt"}),
    ("Your Location is 1200.75, -33.00, 0.5", "location", {"y": 1200, "x": -33, "z": 0}),
    ("Oswin counts 12 nails.", "raw", {}),
    ("", "raw", {}),
]


def test_templates():
    told = compile_template(r"{source:word} rolls [a|b ](up|down) {:number}% \(of {roll}\)...")
    assert told.slots == {"source": 1, "roll": 2} and told.cue == " rolls "
    assert re.search(told.pattern, "Pell rolls up 5% (of 12) and more").groups() == ("Pell", "12")
    assert not re.search(told.pattern, "so Pell rolls 5% (of 12)")


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [("log", i, OWNER, "test", text) for i, (text, _, _) in enumerate(CASES)]
    lines = spark.createDataFrame(rows, "log_id string, seq long, owner string, server string, text string").withColumn("ts", F.lit("2020-07-05 20:31:58").cast("timestamp"))
    return {r["seq"]: r for r in extract_events(lines, [*DEFAULT_RULES, LOCATION]).collect()}


def test_cases(extracted):
    wrong = []
    for i, (text, kind, expected) in enumerate(CASES):
        row = extracted[i]
        found = {k: row[k] for k in expected}
        if row["kind"] != kind or found != expected:
            wrong.append((text, row["kind"], found))
    assert not wrong


def test_lines(spark):
    lines = [
        "[Sun Jul 05 20:31:58 2020] Welcome!",
        "test",
        "[Sun Xxx 05 20:31:58 2020] bad",
        "[Sun Jul 05 20:31:58 2010] too old",
        "[Sun Jul 05 20:31:58 1990] unknown date",
        "[Sun Jul 05 20:31:58 2020] You cannot see your target.",
        "",
        None,
    ]
    df = spark.createDataFrame([("log", i, OWNER, None, x) for i, x in enumerate(lines)], "log_id string, seq long, owner string, server string, line string")
    kept = {r["seq"]: r for r in split_lines(df).collect()}
    assert set(kept) == {0, 4}
    assert kept[0]["text"] == "Welcome!" and str(kept[0]["ts"]) == "2020-07-05 20:31:58"
    assert str(kept[4]["ts"]) == "2018-12-18 00:00:00"
    assert {r["seq"] for r in rejected_lines(df).collect()} == {1, 2, 6, 7}
