"""Word lists and dimensions of the language. All values here are fixed: results must agree with them."""

from __future__ import annotations

# fixed values: object classes, with what is known of them. front: has one of its own; support: things stand on it; container:
# things are in it; fixed: part of the room; small: easily moved; cues: how its front shows, in order; height: usual metres;
# stable: its height varies little
CATEGORIES_TEXT = """
chair: front support cues=backrest,away_from_wall height=0.9 stable
office chair: front support cues=backrest,away_from_wall height=1.0 stable
armchair: front support cues=backrest,away_from_wall height=0.85 stable
sofa: front support cues=backrest,away_from_wall height=0.8 stable
bench: front support cues=backrest,away_from_wall height=0.45 stable
stool: support height=0.5
bed: front support cues=away_from_wall,long_side height=0.6
table: support height=0.75 stable
desk: front support cues=away_from_wall,long_side height=0.75
coffee table: support height=0.4 stable
dining table: support height=0.75 stable
side table: support height=0.6
counter: support fixed height=0.9 stable
countertop: support fixed height=0.9 stable
kitchen counter: support fixed height=0.9 stable
windowsill: support fixed
shelf: front support container cues=away_from_wall,open_face,long_side
bookshelf: front support container cues=away_from_wall,open_face,long_side
shelving unit: front support container cues=away_from_wall,open_face,long_side
cabinet: front support container cues=away_from_wall,open_face,long_side height=0.9
kitchen cabinet: front support container cues=away_from_wall,open_face,long_side height=0.9
wardrobe: front support container cues=away_from_wall,open_face,long_side height=2.0
closet: front support container fixed cues=away_from_wall,open_face,long_side
dresser: front support container cues=away_from_wall,open_face,long_side height=0.9
nightstand: front support container cues=away_from_wall,open_face,long_side height=0.6
sideboard: front support container cues=away_from_wall,open_face,long_side height=0.85
tv stand: front support container cues=away_from_wall,open_face,long_side height=0.5
drawer: front container cues=away_from_wall
box: support container small
basket: container small
suitcase: front container cues=thin_face
backpack: container small
bag: container small
refrigerator: front support container cues=away_from_wall,open_face,long_side height=1.8 stable
oven: front support container cues=away_from_wall,open_face,long_side height=0.9 stable
microwave: front support container cues=thin_face,away_from_wall height=0.3
dishwasher: front support container cues=away_from_wall,open_face,long_side height=0.85 stable
washing machine: front support container cues=away_from_wall,open_face,long_side height=0.85 stable
stove: front support cues=away_from_wall
range hood: front cues=away_from_wall
printer: front cues=away_from_wall height=0.3
tv: front cues=thin_face,away_from_wall height=0.7
monitor: front cues=thin_face,away_from_wall height=0.5
laptop: front cues=backrest,thin_face
keyboard: front small cues=long_side
whiteboard: front fixed cues=thin_face,away_from_wall
mirror: front fixed cues=thin_face,away_from_wall
picture: front fixed cues=thin_face,away_from_wall
poster: front fixed cues=thin_face,away_from_wall
clock: front cues=thin_face,away_from_wall
wall: fixed
floor: support fixed
ceiling: fixed
door: front fixed cues=thin_face,away_from_wall
doorway: fixed
window: front fixed cues=thin_face,away_from_wall
curtain: fixed
blinds: fixed
stairs: front fixed cues=long_side
radiator: front fixed cues=away_from_wall
heater: front fixed cues=away_from_wall
rug: fixed
vent: fixed
toilet: front cues=away_from_wall height=0.75 stable
sink: front container cues=away_from_wall
bathtub: front container cues=away_from_wall
shower: container fixed
towel: small
mug: container small height=0.1
cup: container small height=0.1
glass: container small height=0.12
bottle: container small
can: container small height=0.12
bowl: container small height=0.08
plate: support small
pot: container small
pan: container small
jar: container small
book: front small cues=thin_face
lamp: small
floor lamp: small height=1.5
plant: small height=0.5
vase: container small
trash can: container small height=0.4
pillow: small
cushion: small
blanket: small
phone: front small cues=thin_face
remote: front small cues=long_side
mouse: small
pen: small
paper: small
shoe: front small cues=long_side
clothes: small
speaker: front small cues=thin_face
candle: small
tissue box: container small
ceiling lamp: fixed
fake ceiling: fixed
power socket: fixed
wall outlet: fixed
light switch: fixed
thermostat: fixed
electrical duct: fixed
blind rail: fixed
door frame: fixed
window frame: fixed
pillar: fixed
pipe: fixed
wall clock: front fixed cues=thin_face,away_from_wall
computer tower: front cues=away_from_wall,long_side height=0.42
projector: front cues=long_side
storage cabinet: front support container cues=away_from_wall,open_face,long_side height=1.2
cardboard box: support container small
whiteboard eraser: small
toilet paper: small
cleaning trolley: support container
floor cleaner: small
tripod:
jacket: small
"""

# fixed values: other names, by class
SYNONYMS_TEXT = """
sofa: couch, settee, loveseat
tv: television, tv screen, telly, television set
monitor: computer monitor, display, screen
refrigerator: fridge, freezer, icebox
bookshelf: book shelf, bookcase, book case
shelf: shelves, rack, storage shelf
nightstand: night stand, bedside table
dresser: chest of drawers, commode
trash can: waste bin, wastebasket, bin, garbage can, rubbish bin, dustbin, trashcan, trash bin, waste paper basket
mug: coffee mug
cup: tea cup, teacup
bottle: water bottle, flask
plant: potted plant, houseplant, pot plant
desk: office desk, work desk, writing desk, office table
office chair: swivel chair, desk chair
chair: dining chair, seat
laptop: notebook computer, laptop computer, macbook
washing machine: washer, washing mashine
stove: cooker, hob, cooktop
sink: wash basin, basin, washbasin
toilet: wc, lavatory
picture: photo, painting, photograph, framed picture, artwork, wall art
cabinet: cabinet door, cupboard, kitchen cupboard
tv stand: tv cabinet, media console
sideboard: side board
rug: carpet, mat, doormat
ceiling lamp: light, pendant light, ceiling light
lamp: lamp shade, table lamp, desk lamp
floor lamp: standing lamp
blinds: window blind, window blinds, shade
radiator: radiator heater, heating
phone: cell phone, mobile phone, smartphone
remote: remote control, tv remote
mouse: computer mouse
stairs: stairway, staircase, step
whiteboard: board, blackboard
pipe: pipes
computer tower: computer, pc, desktop computer
power socket: socket, plug socket
electrical duct: duct, electric duct
pillar: column
"""

# fixed values: plurals that rules don't give
PLURALS = {"glasses": "glass", "shelves": "shelf", "boxes": "box", "shoes": "shoe", "dishes": "plate", "clothes": "clothes", "stairs": "stairs", "blinds": "blinds", "trousers": "clothes"}

# fixed values: relations with their family, anchors and other surface forms
RELATIONS_TEXT = """
left projective 1: left of, to the left of, on the left of, left hand side, leftward of, left side
right projective 1: right of, to the right of, on the right of, right hand side, rightward of, right side
front projective 1: in front of, infront of, ahead of, before, in front
behind projective 1: in back of, at the back of, back of, beyond, behind of
on vertical 1: on top of, resting on, sitting on, placed on, lying on, atop, on the top of
above vertical 1: over, higher than, up from
below vertical 1: under, underneath, beneath, lower than, below of, down from
inside vertical 1: in, within, contained in, inside of, in the
near proximity 1: close to, closest to, by, at, nearby, near to, around, beside of, nearest, nearest to
next_to proximity 1: next to, beside, adjacent to, alongside, side by side with, nextto, adjacent
far_from proximity 1: far from, away from, distant from, farthest from, furthest from, farthest, furthest
between proximity 2: in between, in the middle of, amid
taller comparative 1: taller than, higher than than
shorter comparative 1: shorter than, lower than than
bigger comparative 1: bigger than, larger than, greater than
smaller comparative 1: smaller than, tinier than
wider comparative 1: wider than, broader than
ordinal ordinal 0: nth from, counting from, ordinal
"""

# fixed values: more surface forms, and forms that are no relation inside a phrase
EXTRA_FORMS = "to the left of, to the right of, on the left of, on the right of, left of, right of, in front of, behind, on top of, underneath, next to, close to, far from, inside of, in between, between, to the left, to the right, nearest to, furthest from, farthest from, closest to".split(", ")
NO_FORMS = "left, right, front, left side, right side, left hand side, right hand side, beyond, before, at, by, around, within, nearest, farthest, furthest".split(", ")
FORM_PREFIXES = ("to the ", "on the ", "at the ", "in the ", "the ")
FORM_SUFFIXES = (" hand side of", " side of", " of", " from", " than", " to", " with")

# fixed values: buckets of relations
TYPES = {
    "left": "projective_lateral", "right": "projective_lateral", "front": "projective_frontal", "behind": "projective_frontal", "on": "vertical", "above": "vertical", "below": "vertical", "inside": "containment", "between": "between",
    "near": "proximity", "next_to": "proximity", "far_from": "proximity", "taller": "comparative", "shorter": "comparative", "bigger": "comparative", "smaller": "comparative", "wider": "comparative", "ordinal": "ordinal",
}

# fixed values: counting words (place from the start, negative from the end), ends to count from, words for the extreme
ORDINALS = {"first": 0, "second": 1, "third": 2, "fourth": 3, "fifth": 4, "sixth": 5, "seventh": 6, "eighth": 7, "ninth": 8, "tenth": 9, "last": -1, "final": -1, "furthest": -1, "farthest": -1, "penultimate": -2}
ENDS = {
    "left": "left", "leftmost": "left", "right": "right", "rightmost": "right", "front": "front", "nearest": "front", "near": "front", "closest": "front", "back": "behind", "behind": "behind", "rear": "behind", "far": "behind",
    "top": "up", "upper": "up", "highest": "up", "bottom": "down", "lower": "down", "lowest": "down",
}
EXTREMES = {"leftmost": "left", "rightmost": "right", "topmost": "up", "nearest": "front", "closest": "front", "farthest": "behind", "furthest": "behind", "bottommost": "down"}
SIDES = {"left": "left", "right": "right", "top": "up", "upper": "up", "bottom": "down", "lower": "down", "near": "front", "nearer": "front", "far": "behind", "further": "behind", "farther": "behind"}
MIDDLES = ("middle", "centre", "center", "central")
LEVELS = {"top": "top", "topmost": "top", "upper": "top", "highest": "top", "bottom": "bottom", "bottommost": "bottom", "lowest": "bottom", "lower": "bottom", "middle": "middle", "centre": "middle", "center": "middle", "central": "middle"}
LEVEL_NOUNS = "shelf shelves level levels tier tiers row rows drawer drawers rack step layer".split()

# fixed values: sizes (measure and whether more is meant)
SUPERLATIVES = {"tallest": ("height", 1), "highest": ("height", 1), "shortest": ("height", -1), "lowest": ("height", -1), "biggest": ("volume", 1), "largest": ("volume", 1), "smallest": ("volume", -1), "tiniest": ("volume", -1), "widest": ("footprint", 1), "narrowest": ("footprint", -1), "longest": ("length", 1)}
SIZES = {"big": ("volume", 1), "large": ("volume", 1), "huge": ("volume", 1), "small": ("volume", -1), "little": ("volume", -1), "tiny": ("volume", -1), "tall": ("height", 1), "short": ("height", -1), "wide": ("footprint", 1), "narrow": ("footprint", -1), "long": ("length", 1)}

# fixed values: words that phrases drop or set aside
ATTRIBUTES = "red green blue yellow black white grey gray brown orange pink purple silver gold beige cream dark light bright wooden wood metal metallic glass plastic leather fabric steel ceramic cardboard open closed empty full folded".split()
DETERMINERS = "the a an this that these those some any its his her their my our one".split()
GENERIC = "thing things object objects item items one ones something anything".split()
FILLERS = "is are was be to of at there here it that which what does do sits sitting located positioned placed stands standing immediately directly just exactly roughly approximately slightly further way".split()
PLURAL_HINTS = "two three four both all several many".split()
SUPERLATIVE_FORMS = ("nearest", "closest", "furthest", "farthest")
STOPS = "the a an of on in at to from with and or is that this which what near beside next above below under behind by for over inside onto into".split()

# fixed values: colours
COLOURS_TEXT = """
red .72 .15 .15, green .18 .55 .22, blue .18 .32 .72, yellow .88 .80 .20, black .10 .10 .10, white .92 .92 .92, grey .52 .52 .52, gray .52 .52 .52, brown .45 .30 .18, orange .90 .50 .15, pink .92 .60 .70, purple .50 .25 .60,
silver .75 .75 .78, beige .85 .78 .65, cream .95 .92 .82, gold .80 .65 .20, wooden .55 .40 .25, wood .55 .40 .25
"""

# fixed values: what wraps or hedges a phrase, in order
WRAPPERS = (
    r"^(?:which|what|where)(?:\s+(?:one|object|thing|item))?\s+(?:is|are|of these is)\s+",
    r"^(?:which|what)\s+",
    r"^(?:please\s+)?(?:find|locate|point (?:at|to)|show me|select|highlight|identify|give me|tell me|get|pick(?: out)?|click(?: on)?)\s+",
    r"^(?:can you|could you|i want|i need)\s+(?:to\s+)?(?:find|show me|see)?\s*",
    r"^(?:the\s+)?(?:location|position)\s+of\s+",
)
HEDGES = "as far as i can tell, if i am not mistaken, if i'm not mistaken, as best i can tell, i think, i believe, i would say, presumably, apparently".split(", ")

# fixed values: words that name a frame: pattern, kind, weight, rule, viewpoint
NOUN_PHRASE = r"((?:[a-z]+ ){0,3}[a-z]+)"
PLACES = "door|doorway|entrance|entry|window|sofa|couch|bed|desk|table|kitchen|corner|whiteboard|sink"
VIEWER_CUES = (
    (r"\bfrom (?:my|the viewer'?s?|our) (?:point of view|pov|perspective|view|side)\b", "egocentric"),
    (r"\bfrom where (?:i|we|you)(?:'m| am|'re| are)? (?:standing|stood|sitting)\b", "egocentric"),
    (r"\bfrom (?:my|our) (?:vantage|angle|position|viewpoint)\b", "egocentric"),
    (r"\bfrom (?:here|there|this angle|this side|this position)\b", "egocentric"),
    (r"\bas (?:i|we) (?:see|look at|am looking at|view)\b", "egocentric"),
    (r"\bfrom the camera(?:'s)?(?: point of view| perspective| view)?\b", "egocentric"),
    (r"\bin (?:the |this )?(?:image|picture|photo|photograph|frame|shot|view|screen)\b", "egocentric_image"),
    (r"\bon (?:the )?screen\b", "egocentric_image"),
    (r"\bmy (?:left|right)\b", "egocentric"),
    (r"\bto me\b", "egocentric"),
    (r"\bnearer (?:to )?(?:me|us|the camera)\b", "egocentric"),
)
INTRINSIC_CUES = (
    rf"\bfrom (?:the )?{NOUN_PHRASE}'s (?:point of view|pov|perspective|view)\b",
    r"\bits own (?:left|right|front|back)\b",
    r"\bon its (?:left|right)\b",
    rf"\bas (?:the )?{NOUN_PHRASE} faces\b",
    rf"\bin the direction (?:the )?{NOUN_PHRASE} (?:faces|is facing)\b",
)
POSSESSIVE = r"\b((?:[a-z]+ ){0,3}[a-z]+)'s (?:own )?(left|right|front|back|rear)\b"
ADDRESSEE_CUES = (
    r"\b(?:if|when|as) you(?:'re| are)? (?:facing|stood facing|standing in front of|looking at)\b",
    rf"\bfacing (?:the )?{NOUN_PHRASE}\b",
    rf"\bfrom the front of (?:the )?{NOUN_PHRASE}\b",
    r"\bstanding in front of\b",
)
WORLD_CUES = (
    r"\bthe (?:left|right) side of the room\b",
    r"\bthe (?:left|right) (?:half|part|end) of the room\b",
    r"\bthe room'?s? (?:left|right|front|back)\b",
    r"\bthe (?:north|south|east|west) (?:wall|side|end|corner)\b",
    r"\bthe (?:far|near) (?:end|side|wall) of the room\b",
    r"\bthe (?:left|right) wall\b",
    r"\bin room coordinates\b",
)
STAND_CUE = rf"\b(?:standing at|standing by|standing in|seen from|viewed from|looking from|if you stand at|when you stand at) (?:the )?({PLACES})\b"
FROM_CUE = rf"\bfrom (?:the )?({PLACES})\b(?!'s)"
ENTER_CUE = r"\b(?:as|when) (?:you|i|we) (?:walk|come|enter|step) (?:in|into|inside|through the door)\b"


def categories() -> dict[str, dict]:
    out = {}
    for line in CATEGORIES_TEXT.strip().splitlines():
        name, _, rest = line.partition(":")
        words = rest.split()
        value = lambda k, ws=words: next((w.split("=")[1] for w in ws if w.startswith(k + "=")), None)
        out[name] = {k: k in words for k in ("front", "support", "container", "fixed", "small", "stable")} | {"cues": (value("cues") or "").split(",") if value("cues") else [], "height": float(value("height")) if value("height") else None}
    return out


def synonyms() -> dict[str, str]:
    return {k: line.partition(": ")[0] for line in SYNONYMS_TEXT.strip().splitlines() for k in line.partition(": ")[2].split(", ")}


def relations() -> dict[str, tuple[str, int, list[str]]]:
    """By name: family, number of anchors, other surface forms."""
    out = {}
    for line in RELATIONS_TEXT.strip().splitlines():
        head, _, forms = line.partition(": ")
        name, family, anchors = head.split()
        out[name] = (family, int(anchors), forms.split(", "))
    return out


def colours() -> dict[str, tuple[float, float, float]]:
    return {w: tuple(map(float, rgb)) for w, *rgb in (x.split() for x in COLOURS_TEXT.replace("\n", " ").split(","))}
