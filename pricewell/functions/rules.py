"""Word lists and patterns that results depend on, in the order in which they are tried.

Patterns are written with ASCII word boundaries; `ascii_words` turns them into the Java dialect.
"""

from __future__ import annotations

import re

#: Listing titles that aren't one single card.
SKIP_TITLES = [
    r"\bpsa\s*\d", r"\bbgs\s*\d", r"\bcgc\s*\d", r"\bsgc\s*\d", r"\bproxy\b", r"\bproxies\b", r"\bbulk\b", r"\blot\s+of\s+\d",
    r"\b\d+\s*card[s]?\s+lot", r"\bcomplete\s+set\b", r"\bcomplete\s+playset\b", r"\bchoose\s+your\b", r"\bpick\s+your\b", r"\bpick\s+a\b",
    r"\bmultibuy\b", r"\byou\s+pick\b", r"\bselect\s+multibuy\b", r"\d+%\s*off", r"\bnon[-\s]*singles\b", r"\btmnt\b",
    r"\bteenage\s+mutant\s+ninja\b", r"\byugioh\b", r"\bpokemon\b", r"\bdigimon\b", r"\bforce\s+of\s+will\b", r"\bfactory\s*sealed\b",
    r"\bsealed\b", r"\bbooster\b", r"\bdraft\s+pack", r"\bbooster\s*box", r"\bbundle\b", r"\bcommander\s*deck", r"commander\s*(–|-)\s",
    r"\bprecon\b", r"\bprerelease\b", r"\bstarter\s*kit", r"\bgift\s*edition", r"\bcollect[ors]?\s*box", r"\bset\s*booster",
    r"\bdraft\s*booster", r"\bplay\s*booster", r"\bjump\s*start", r"\bbinder\b", r"\balbum\b", r"\bsticker[s]?\b", r"\bsuppl[ies]+\b",
    r"\bsleeve[s]?\b", r"\bdeck\s+box", r"\bplaymat\b", r"\bdice\b", r"\bgift\s+card", r"\btoken\b", r"\bemblem\b", r"\bcounter[s]?\b",
]

FOIL_WORD = r"\bfoil\b"

#: Condition by title, the first hit counts.
TITLE_CONDITIONS = [
    (r"\bnm[-/]?m\b", "NM"), (r"\bnear\s*mint\b", "NM"), (r"\bnm\b", "NM"), (r"\bmint\b", "NM"), (r"\blp\b", "LP"),
    (r"\blight[ly]?\s*played\b", "LP"), (r"\bsp\b", "LP"), (r"\bslight[ly]?\s*played\b", "LP"), (r"\bmp\b", "MP"),
    (r"\bmod[erately]*\s*played\b", "MP"), (r"\bhp\b", "HP"), (r"\bheavily?\s*played\b", "HP"), (r"\bdmg\b", "DMG"),
    (r"\bdamaged\b", "DMG"), (r"\bpoor\b", "DMG"), (r"\bexcellent\b", "LP"), (r"\bex\b", "LP"), (r"\bvery\s*good\b", "LP"), (r"\bgood\b", "MP"),
]

#: Condition by what the shop's own field holds, the first hit counts.
FIELD_CONDITIONS = [("new", "NM"), ("mint", "NM"), ("very good", "LP"), ("good", "MP"), ("acceptable", "HP"), ("for parts", "DMG"), ("used", "LP")]

#: Set name by title, the first hit counts.
TITLE_SETS = [
    (r"\balpha\b", "Limited Edition Alpha"), (r"\bbeta\b", "Limited Edition Beta"), (r"\bunlimited\b", "Unlimited Edition"),
    (r"\brevised\b", "Revised Edition"), (r"\b3rd\s*ed", "Revised Edition"), (r"\barabian\s*nights\b", "Arabian Nights"),
    (r"\bantiquitie[s]?\b", "Antiquities"), (r"\bmultiverse\s*legends\b", "March of the Machine: The Multiverse Legends"),
    (r"\blegends\b", "Legends"), (r"\bthe\s*dark\b", "The Dark"), (r"\bfallen\s*empires\b", "Fallen Empires"),
    (r"\bhomelands\b", "Homelands"), (r"\balliances\b", "Alliances"), (r"\bmirage\b", "Mirage"), (r"\bvisions\b", "Visions"),
    (r"\bweatherligh[t]?\b", "Weatherlight"), (r"\btempest\b", "Tempest"), (r"\bstronghold\b", "Stronghold"), (r"\bexodus\b", "Exodus"),
    (r"\burzas?\s*saga\b", "Urza's Saga"), (r"\burzas?\s*legacy\b", "Urza's Legacy"), (r"\burzas?\s*destiny\b", "Urza's Destiny"),
    (r"\bmercadian\s*masques\b", "Mercadian Masques"), (r"\bnemesis\b", "Nemesis"), (r"\bprophecy\b", "Prophecy"),
    (r"\binvasion\b", "Invasion"), (r"\bplaneshift\b", "Planeshift"), (r"\bapocalypse\b", "Apocalypse"), (r"\bodyssey\b", "Odyssey"),
    (r"\btorment\b", "Torment"), (r"\bjudgment\b", "Judgment"), (r"\bonnslaugth[t]?\b", "Onslaught"), (r"\blegions\b", "Legions"),
    (r"\bscourge\b", "Scourge"), (r"\bmirrodin\b", "Mirrodin"), (r"\bdarksteel\b", "Darksteel"), (r"\bfifth\s*dawn\b", "Fifth Dawn"),
    (r"\bchampions\b", "Champions of Kamigawa"), (r"\bbetrayers\b", "Betrayers of Kamigawa"), (r"\bsaviors\b", "Saviors of Kamigawa"),
    (r"\bravnica\b.*\bguild\b", "Ravnica: City of Guilds"), (r"\bguildpact\b", "Guildpact"), (r"\bdissension\b", "Dissension"),
    (r"\bcoldsnap\b", "Coldsnap"), (r"\btime\s*spiral\b", "Time Spiral"), (r"\bplanar\s*chaos\b", "Planar Chaos"),
    (r"\bfuture\s*sight\b", "Future Sight"), (r"\bninth\s*ed", "Ninth Edition"), (r"\btenth\s*ed", "Tenth Edition"),
    (r"\blorwyn\b", "Lorwyn"), (r"\bmorningtide\b", "Morningtide"), (r"\bshadowmoor\b", "Shadowmoor"), (r"\bevernight\b", "Eventide"),
    (r"\bshards\s*of\s*alara\b", "Shards of Alara"), (r"\bconflux\b", "Conflux"), (r"\balara\s*reborn\b", "Alara Reborn"),
    (r"\bzen\b", "Zendikar"), (r"\bzendikar\b", "Zendikar"), (r"\bworldwake\b", "Worldwake"),
    (r"\brise\s*of\s*the\s*eldrazi\b", "Rise of the Eldrazi"), (r"\bscars\s*of\s*mirrodin\b", "Scars of Mirrodin"),
    (r"\bmirrodin\s*besieged\b", "Mirrodin Besieged"), (r"\bnew\s*phyrexia\b", "New Phyrexia"), (r"\binnistrad\b", "Innistrad"),
    (r"\bdark\s*ascension\b", "Dark Ascension"), (r"\bavacyn\s*restored\b", "Avacyn Restored"), (r"\bravnica\b", "Return to Ravnica"),
    (r"\bgatecrash\b", "Gatecrash"), (r"\bdragon[s]?\s*maze\b", "Dragon's Maze"), (r"\btheros\b", "Theros"),
    (r"\bbor[n]?\s*(in|of)\s*gods\b", "Born of the Gods"), (r"\bjourney\s*into\s*nyx\b", "Journey into Nyx"),
    (r"\bkhans\s*of\s*tarkir\b", "Khans of Tarkir"), (r"\bfate\s*reforged\b", "Fate Reforged"),
    (r"\bdragons\s*of\s*tarkir\b", "Dragons of Tarkir"), (r"\bbattle\s*for\s*zendikar\b", "Battle for Zendikar"),
    (r"\boath\s*of\s*the\s*gatewatch\b", "Oath of the Gatewatch"), (r"\bshadows\s*over\s*innistrad\b", "Shadows over Innistrad"),
    (r"\beldritch\s*moon\b", "Eldritch Moon"), (r"\bamonkhet\b", "Amonkhet"), (r"\bhour\s*of\s*devastation\b", "Hour of Devastation"),
    (r"\bixalan\b", "Ixalan"), (r"\brivals\s*of\s*ixalan\b", "Rivals of Ixalan"), (r"\bdom\b", "Dominaria"), (r"\bdominaria\b", "Dominaria"),
    (r"\bguilds\s*of\s*ravnica\b", "Guilds of Ravnica"), (r"\bravnica\s*allegiance\b", "Ravnica Allegiance"),
    (r"\bwar\s*of\s*the\s*spark\b", "War of the Spark"), (r"\bthrone\s*of\s*eldraine\b", "Throne of Eldraine"),
    (r"\btheros\s*beyond\b", "Theros Beyond Death"), (r"\bikoria\b", "Ikoria: Lair of Behemoths"),
    (r"\bcore\s*(set\s*)?2019\b", "Core Set 2019"), (r"\bcore\s*(set\s*)?2020\b", "Core Set 2020"),
    (r"\bcore\s*(set\s*)?2021\b", "Core Set 2021"), (r"\bzendikar\s*rising\b", "Zendikar Rising"), (r"\bkaldheim\b", "Kaldheim"),
    (r"\bstrixhaven\b", "Strixhaven: School of Mages"), (r"\bafr\b", "Adventures in the Forgotten Realms"),
    (r"\bforgotten\s*realms\b", "Adventures in the Forgotten Realms"), (r"\binnistrad\s*mid", "Innistrad: Midnight Hunt"),
    (r"\bcrimson\s*vow\b", "Innistrad: Crimson Vow"), (r"\bneon\s*dynasty\b", "Kamigawa: Neon Dynasty"), (r"\bneo\b", "Kamigawa: Neon Dynasty"),
    (r"\bstreets\s*of\s*new\s*capenna\b", "Streets of New Capenna"), (r"\bdomin[aria]*\s*united\b", "Dominaria United"),
    (r"\bdmu\b", "Dominaria United"), (r"\bbrothers[']?\s*war\b", "The Brothers' War"), (r"\bphyrexia\s*all\b", "Phyrexia: All Will Be One"),
    (r"\bmarch\s*of\s*the\s*machine\b", "March of the Machine"), (r"\bwilds\s*of\s*eldraine\b", "Wilds of Eldraine"),
    (r"\blost\s*caverns\b", "The Lost Caverns of Ixalan"), (r"\bmurders\b.*\bkarlov\b", "Murders at Karlov Manor"),
    (r"\boutlaws\b.*\bthunder\b", "Outlaws of Thunder Junction"), (r"\bbloomburrow\b", "Bloomburrow"),
    (r"\bduskmourn\b", "Duskmourn: House of Horror"), (r"\bfoundations\b", "Magic: The Gathering Foundations"),
    (r"\btarkir\s*dragonstorm\b", "Tarkir: Dragonstorm"), (r"\bfinal\s*fantasy\b", "Final Fantasy"), (r"\bfca\b", "Final Fantasy"),
    (r"\baetherdrift\b", "Aetherdrift"), (r"\bone\s*ring\b", "The Lord of the Rings: Tales of Middle-earth"),
    (r"\blord[s]?\s*of\s*the\s*rings\b", "The Lord of the Rings: Tales of Middle-earth"),
    (r"\blotr\b", "The Lord of the Rings: Tales of Middle-earth"), (r"\bsecret\s*lair\b", "Secret Lair Drop"), (r"\bsld\b", "Secret Lair Drop"),
    (r"\bafter(math)?\b", "March of the Machine: The Aftermath"), (r"\bmul\b", "March of the Machine: The Multiverse Legends"),
    (r"\bwoe\b", "Wilds of Eldraine"), (r"\blci\b", "The Lost Caverns of Ixalan"), (r"\bmkm\b", "Murders at Karlov Manor"),
    (r"\botj\b", "Outlaws of Thunder Junction"), (r"\bblb\b", "Bloomburrow"), (r"\bdsk\b", "Duskmourn: House of Horror"),
    (r"\bfdn\b", "Magic: The Gathering Foundations"), (r"\bm10\b", "Magic 2010"), (r"\bm11\b", "Magic 2011"), (r"\bm12\b", "Magic 2012"),
    (r"\bm13\b", "Magic 2013"), (r"\bm14\b", "Magic 2014"), (r"\bm15\b", "Magic 2015"),
]

#: What is taken out of a title before its card name is read, in this order.
TITLE_NOISE = [
    r"\[[^\]]*\]", r"\(\s*[\d/]+\s*\)", r"#\s*\d+", r"\bmagic\s*(the\s*gathering|:?\s*the\s*gathering)?\b", r"\bmtg\b", r"\bfoil\b",
    r"\betched\s*foil\b", r"\bextended\s*art\b", r"\bborderless\b", r"\balt\s*art\b", r"\bsignature\s*series\b", r"\bx\s*[1-9]\d*\b",
    r"\b[1-9]\d*\s*x\b", r"\bplayset\b",
    r"\b(near\s*mint|nm[-/]?m?|light[ly]?\s*played|lp|slight[ly]?\s*played|sp|mod[erately]*\s*played|mp|heavily?\s*played|hp|damaged|dmg|poor|mint|excellent|very\s*good)\b",
    r"\bex\b", r"\bregular\b", r"\bshowcase\b", r"\bserialized\b", r"\bgalaxy\s*foil\b", r"\btextured\s*foil\b",
    r"\buniverses\s*(beyond|within)\b", r"\bjapanese\b", r"\benglish\b", r"\b(promo|prerelease\s*promo|buy[- ]a[- ]box)\b", r"\bsingle\b",
    r"\bcard\b", r"\brare\b", r"\buncommon\b", r"\bcommon\b", r"\bmythic\b", r"\boriginal\b", r"\blegit\b", r"\breal\b", r"\bauthentic\b",
    r"\bcollector\b", r"\bedition\b", r"[-–—|·•:]+",
]

#: Condition names of shop A and of shop B.
CONDITIONS_A = {"regular": "NM", "lightly played": "LP", "moderately played": "MP", "heavily played": "HP", "damaged": "DMG"}
CONDITIONS_B = {
    "near mint": "NM", "nm": "NM", "mint": "NM", "m": "NM", "lightly played": "LP", "light played": "LP", "lp": "LP", "excellent": "LP", "ex": "LP",
    "moderately played": "MP", "moderate played": "MP", "mp": "MP", "good": "MP", "gd": "MP", "heavily played": "HP", "heavy played": "HP",
    "hp": "HP", "played": "HP", "damaged": "DMG", "dmg": "DMG", "poor": "DMG",
}

#: Shop B: phrases of variants that aren't listed, and the words and axes of its variants.
SKIPPED_VARIANTS = [
    "extended art", "showcase", "retro frame", "retro border", "alternate art", "full art", "surge foil", "galaxy foil", "gilded foil",
    "rainbow foil", "textured foil", "etched foil", "serialized", "step-and-compleat", "schematic", "anime",
]
FOIL_WORDS = ["foil", "etched foil", "galaxy foil", "gilded foil", "surge foil", "rainbow foil", "textured foil"]
NON_FOIL_WORDS = ["non-foil", "nonfoil", "non foil", "regular"]
CONDITION_AXES = ["condition", "conditions"]
FOIL_AXES = ["finish", "foil", "treatment", "printing"]

#: Set codes by normalised set name.
SET_ALIASES = {
    "revised": "3ed", "revised edition": "3ed", "fourth edition": "4ed", "fourth ed": "4ed", "fifth edition": "5ed", "sixth edition": "6ed",
    "classic sixth edition": "6ed", "seventh edition": "7ed", "eighth edition": "8ed", "ninth edition": "9ed", "tenth edition": "10e",
    "alpha": "lea", "beta": "leb", "unlimited": "2ed", "unlimited edition": "2ed", "ravnica": "rav", "ravnica city of guilds": "rav",
    "time spiral": "tsp", "lorwyn": "lrw", "morningtide": "mor", "shadowmoor": "shm", "eventide": "eve",
}

#: Layouts that the catalogue leaves out.
SKIPPED_LAYOUTS = ["token", "double_faced_token", "art_series", "emblem", "vanguard", "scheme", "planar"]

#: Shops: id, name, address, enabled.
STORES = [
    ("mtg_mate", "MTG Mate", "https://www.mtgmate.com.au", True),
    ("good_games", "Good Games", "https://tcg.goodgames.com.au", True),
    ("mana_market", "Mana Market", "https://manamarket.com.au", False),
    ("mtg_singles_aus", "MTG Singles Australia", "https://www.mtgsinglesaustralia.com.au", False),
    ("ebay_au", "eBay AU", "https://www.ebay.com.au", True),
]
MARKET_STORE = "ebay_au"

#: Search tiers: rank in the due list, days between searches after hits, and after none.
TIERS = [("hot", 1, 1, 14), ("active", 2, 3, 21), ("longTail", 3, 7, 30)]


WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def ascii_words(pattern: str) -> str:
    """A pattern for Java, ignoring case, in which \\b is a boundary of ASCII words.

    Before a letter or digit only a word's begin can stand, and after one only its end, so that one look is enough there.
    """
    begins = re.sub(r"\\b(?=[A-Za-z0-9])", lambda m: f"(?<!{WORD})", pattern)
    ends = re.sub(r"(?<![\\])([A-Za-z0-9])\\b", lambda m: f"{m[1]}(?!{WORD})", begins)
    return "(?i)" + ends.replace(r"\b", EDGE)
