"""Patterns of the text rules. All of this file is fixed values: a rule gives the
right answer only with exactly these patterns, in this order."""

# --- free-text totals -----------------------------------------------------------
SPECIES = [
    ("largemouth", r"lmb\b|largemouth|large mouth|black bass|\bl\.?m\.?\b"),
    ("smallmouth", r"smb\b|smallmouth|small mouth"),
    ("spotted_bass", r"spotted bass|spots\b|kentucky bass"),
    ("crappie", r"crappie|slab"),
    ("catfish", r"catfish|channel cat|blue cat|flathead|\bcats\b|\bcat\b"),
    ("sunfish", r"bluegill|blue gill|bream|brim\b|perch|sunfish|\bgills?\b|redear|shellcracker"),
    ("white_bass", r"white bass|sand bass|sandie|striper|hybrid|wiper"),
    ("carp", r"\bcarp\b"),
    ("gar", r"\bgar\b"),
    ("drum", r"\bdrum\b"),
    ("largemouth", r"\bbass\b"),
]
NUMBER = r"(?:\d+(?:[.,]\d+)?|[.,]\d+)"
WEIGHT_UNIT = r"(?:lbs?\b|lb\b|pounds?\b|#)"
LENGTH_UNIT = r"""(?:"|”|''|inch(?:es)?\b|in\b)"""
SIZE = rf"(?i){NUMBER}\s*(?:{WEIGHT_UNIT}|{LENGTH_UNIT})"
WEIGHT = rf"(?i)({NUMBER})\s*{WEIGHT_UNIT}"
LENGTH = rf"(?i)({NUMBER})\s*{LENGTH_UNIT}"
BAG = (r"(?i)(?:\bbag\b|best\s*(?:five|5)\b|top\s*(?:five|5)\b|\bstringer\b|total(?:ing|ling)\b"
       r"|\bcombined\b|all\s*together|altogether|\d+\s*(?:biggest|best|largest)\b)")
SINGLE = r"(?i)(?:largest|biggest|big\s*(?:one|fish)|best\s*fish|up\s*to|max\b|@|\bto\b|-\s*$)"
COUNT_SPECIES = r"(?i)(\d+)\s*(?:[a-z]+\s+){0,2}?(" + "|".join(p for _, p in SPECIES) + ")"
VAGUE = (r"(?i)\b(?:lots|bunch|many|several|plenty|fair number|a few|handful|numerous|good number"
         r"|tons)\b")
WEIGHT_RANGE, LENGTH_RANGE, MAX_COUNT = (0.1, 18.0), (4, 40), 500
LEAD_CHARS, TRAIL_CHARS = 16, 12

# --- narrative features ----------------------------------------------------------
_N = r"(\d+(?:\.\d+)?)"
_FT = r"(?:feet|foot|ft\b|fow\b|'|’)"
_IN = r"""(?:inches|inch\b|in\b|"|”)"""
_VIZ = r"(?:visibility|visibilty|visbility|visability|viz|clarity|clear to|see down)"
INCH_UNIT = rf"(?i)^{_IN}$"
CLARITY_NUMBERS = [
    rf"(?i){_N}\s*({_FT}|{_IN})\s*(?:of\s*)?{_VIZ}",
    rf"(?i){_VIZ}[^.,;\n]{{0,20}}?{_N}\s*(?:-|to)?\s*(?:\d+(?:\.\d+)?)?\s*({_FT}|{_IN})",
]
CLARITY_WORDS = [
    ("gin_clear", r"gin[\s-]?clear|crystal[\s-]?clear"),
    ("clear", r"very clear|pretty clear|fairly clear|clear"),
    ("lightly_stained", r"slightly stained|lightly stained|light stain|a little stained"),
    ("stained", r"heavily stained|stained|dingy|off[\s-]?colou?r|tannic"),
    ("murky", r"murky|turbid|cloudy"),
    ("muddy", r"muddy|chocolate|mud[\s-]?hole|dirty"),
]
_WATER = r"(?:water|lake|pond|tank|creek)"
CLARITY_LABELS = [
    (name, rf"(?i)(?:{_WATER}\b[^.\n]{{0,45}}?\b(?:{p})\b)|(?:\b(?:{p})\b[^.\n]{{0,30}}?\b{_WATER}\b)")
    for name, p in CLARITY_WORDS]
WATER_TEMP = [
    rf"(?i)water\s*temp\w*\D{{0,18}}?{_N}\s*(?:-|to)?\s*(?:\d+)?\s*(?:degrees?|deg\b|°|\*?\s*f\b)?",
    rf"(?i)water\s*(?:was|is|at)\s*{_N}\s*(?:degrees?|deg\b|°|\*?\s*f\b)",
    rf"(?i){_N}\s*(?:degree|°|\*)\s*(?:f\b)?\s*water",
]
WATER_TEMP_RANGE = (32, 100)
DEPTH = (rf"(?i)\b(?:in|at|around|about|down\s+to|out\s+to|to)\s*{_N}\s*(?:-|to)?\s*({_N})?\s*{_FT}"
         r"(?:\s*of\s*water)?")
MAX_DEPTH, MAX_CLARITY = 60, 30
BITE_WINDOW = [
    ("dawn", r"(?i)sun\s*rise|sunrise|sun\s*up|\bdawn\b|first light|before light|day\s*break|daybreak"),
    ("morning", r"(?i)\bmorning\b|\bam\b(?!\s*-)|early"),
    ("midday", r"(?i)mid\s*day|midday|\bnoon\b|lunch"),
    ("afternoon", r"(?i)afternoon"),
    ("evening", r"(?i)\bevening\b|\bdusk\b|sun\s*set|sunset|last light"),
    ("night", r"(?i)\bnight\b|after dark|\bdark\b"),
]
BLANK = (r"(?i)skunk(?:ed)?|\bno fish\b|zero fish|didn'?t catch|did not catch|never caught|blanked"
         r"|struck out|nothing to show|got\s+skunked|no bites|not a (?:single )?(?:fish|bite)")

# --- tags -------------------------------------------------------------------------
VEGETATION = [
    ("hydrilla", r"hydrilla"), ("milfoil", r"milfoil"), ("coontail", r"coontail"),
    ("lily_pads", r"lily\s*pad|lilypad|\bpads\b|lilies"), ("reeds", r"\breeds?\b|cattail|bulrush"),
    ("moss", r"\bmoss\b|filamentous"), ("algae", r"algae|\bscum\b"), ("duckweed", r"duckweed"),
    ("pepper_grass", r"pepper\s*grass"), ("mats", r"\bmats?\b|\bslop\b|matted"),
    ("grass_generic", r"\bgrass\b|\bweeds?\b|\bvegetation\b|\bsalad\b|\bgreenery\b"),
]
DENSITY = [
    ("heavy", r"(?i)thick|heavy|dense|matted|choked|loaded with|tons of|lots of|full of|solid"),
    ("moderate", r"(?i)some|moderate|patchy|scattered|decent|fair amount"),
    ("light", r"(?i)sparse|thin|little|minimal|not much|hardly any|starting to|minimum"),
    ("none", r"(?i)\bno\b|none|without any|died off|gone"),
]
DENSITY_BEFORE, DENSITY_AFTER = 60, 20
STRUCTURE = [
    ("weed_edge", r"weed\s*(?:edge|line)|grass\s*(?:edge|line)|edge of the (?:grass|weeds|hydrilla)"),
    ("points", r"\bpoints?\b"), ("docks", r"\bdocks?\b|boat house|boathouse|pier"),
    ("timber", r"timber|standing tree|dead tree|snag"), ("laydowns", r"laydown|fallen tree|blow\s*down"),
    ("brush", r"brush\s*pile|brushpile|\bbrush\b"), ("stumps", r"\bstumps?\b"), ("dam", r"\bdam\b|levee"),
    ("riprap", r"rip\s*rap|riprap|rock wall"),
    ("creek_channel", r"creek\s*channel|old channel|channel swing"),
    ("drop_off", r"drop\s*off|dropoff|\bledge\b|break line|breakline"), ("flats", r"\bflats?\b"),
    ("coves", r"\bcoves?\b|\bpockets?\b|back of the creek"),
    ("shoreline", r"shoreline|\bbank\b|shallows|\bshore\b"), ("island", r"\bisland\b"),
    ("spillway", r"spillway|overflow|culvert|inflow"),
    ("open_water", r"open water|middle of the lake|main lake"),
]
TECHNIQUE = [
    ("weightless", r"weightless|no weight|unweighted"), ("texas_rig", r"texas\s*rig|t-?rig\b|tx\s*rig"),
    ("carolina_rig", r"carolina\s*rig|c-?rig\b"), ("drop_shot", r"drop\s*shot|dropshot"), ("wacky", r"wacky"),
    ("neko", r"\bneko\b"), ("ned", r"\bned\b"), ("shaky_head", r"shak(?:e|y)y?\s*head"),
    ("punching", r"punch(?:ing|ed)?\b"), ("flipping", r"flipp?(?:ing|ed)|pitch(?:ing|ed)"),
    ("burning", r"burn(?:ing|ed)\s|fast retrieve|reeling fast"),
    ("slow_roll", r"slow\s*roll|slow\s*retriev|crawl(?:ing|ed)?\s+it"),
    ("dead_stick", r"dead\s*stick|let it sit|soak(?:ing|ed)?\b"), ("twitching", r"twitch(?:ing|ed)?"),
    ("walking", r"walk(?:ing)?\s*the\s*dog"), ("dragging", r"drag(?:ging|ged)"),
    ("hopping", r"hopp(?:ing|ed)|stroking"), ("pauses", r"\bpaus(?:e|es|ing|ed)\b|long pause|let it fall"),
    ("topwater_early", r"top\s*water early|early top"),
]

# --- location snippets --------------------------------------------------------------
SENTENCE = r"[^.!?]*[.!?]"
SENTENCE_END = r"(?<=[.!?])"
USEFUL = (r"\b(?:drive|drove|driving)\s+(?:up\s+|down\s+|over\s+|out\s+)?(?:from|to|past|through)\s+[A-Z]"
          r"|\b(?:north|south|east|west)\s+of\s+[A-Z]|\b(?:highway|hwy|fm|us|i-)\s*\d+|\b[A-Z][a-z]+\s+County\b")
NOISE = r"(?i)\b(?:four|4)\s*wheel\s*drive\b|\bfished?\s+\d+\s*(?:hour|hr)"
