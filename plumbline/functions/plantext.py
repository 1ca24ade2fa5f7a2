"""Column expressions that read plan text: dimensions, scales, labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# --- fixed values: word lists ----------------------------------------------------------------
ROOM_WORDS_TABLE = (
    "ROOM CORRIDOR OFFICE STAIR ELEV LOBBY STORAGE STORE OXYGEN BATH RESTROOM TOILET MECH ELECTRICAL JANITOR "
    "KITCHEN LOCKER VEST LOUNGE WAIT PANTRY CLOSET UTILITY LINEN EXAM CONF RECEPTION STAFF PATIENT BEDROOM "
    "BED DINING LIVING GARAGE FOYER LAUNDRY POWDER HALL WIC PWDR MASTER ENTRY DEN STUDY NOOK PORCH DECK PATIO "
    "MUDROOM MUD FAMILY GREAT MEDIA BONUS REC HOBBY GUEST NURSERY PLAYROOM GYM FLEX PRIMARY ENSUITE BALCONY "
    "WORK ALCOVE VESTIBULE HALLWAY ATTIC BASEMENT CELLAR FORMAL BREAKFAST MORNING CRAFT SHOP MECHANICAL "
    "RECREATION GAMES ENTRANCE SUNROOM GARDEN GREENHOUSE")
ROOM_WORDS_CANDIDATE = (
    "ROOM CORRIDOR OFFICE STAIR ELEV LOBBY STORAGE STORE OXYGEN BATH RESTROOM TOILET MECH ELECTRICAL JANITOR "
    "KITCHEN LOCKER VEST LOUNGE WAIT PANTRY CLOSET UTILITY SOIL CLEAN SOILED LINEN EXAM CONF RECEPTION STAFF "
    "PATIENT NOURISH ALCOVE VESTIBULE LINK CONNECTING VOLTAGE VEND BEDROOM BED DINING LIVING GARAGE FOYER "
    "LAUNDRY POWDER HALL WIC PWDR MASTER ENTRY DEN STUDY NOOK PORCH DECK PATIO MUDROOM MUD FAMILY GREAT MEDIA "
    "BONUS REC HOBBY GUEST NURSERY PLAYROOM GYM")
NO_ROOM_TABLE = (
    "SF SQFT TYP DET DETAIL NOTE NOTES SEE ALIGN VIF REF SECTION ELEVATION PLAN DRAWING SHEET SCALE TITLE "
    "STAMP REVISION PROJECT ARCHITECT ENGINEER CONSULTANT FINISH SCHEDULE GENERAL LEGEND KEY SYMBOL CODE "
    "NAVIGATION DEPARTMENT VETERANS RENDERING OVERVIEW WINDOW DOOR GLASS SLIDER SLIDING DOORS SHOWER ART WALL "
    "COLLECTION WINNER AWARD HICKORY MULBERRY WALNUT PALM WILLOW PINE TAMARIND PEACH SANDALWOOD MAPLE OAK "
    "BIRCH CEDAR TREATED PRESSURE LEDGER CONSTRUCTION TYPICAL PROVIDE INSTALL EXIST EXISTING REMOVE RELOCATE "
    "FOR FROM ROOF PEAK JOIST FRAMING HEADER BEAM STUD RAFTER RAIL RAILING HANDRAIL GUARDRAIL BLOCKING SIDING "
    "SOFFIT FASCIA FOUNDATION FOOTING SLAB BACKFILL GRADE CHAIR DESK WARDROBE WARDR0BE CABINET COUNTER "
    "DISPENSER TISSUE NIGHTSTAND FURNISHING FURNITURE BOOKCASE DRESSER MIRROR")
NO_ROOM_CANDIDATE = (
    "SF SQFT TYP DET DETAIL NOTE NOTES SEE ALIGN VIF REF SECTION ELEVATION PLAN DRAWING SHEET SCALE TITLE "
    "STAMP REVISION PROJECT ARCHITECT ENGINEER CONSULTANT FINISH SCHEDULE GENERAL LEGEND KEY SYMBOL CODE "
    "NAVIGATION DEPARTMENT VETERANS RENDERING OVERVIEW WINDOW DOOR")
ANNOTATIONS = (
    r"column|columns|glass roof|roof|north|south|east|west|legend|notes?|key|symbols?|scale|true north|grid|datum|"
    r"align|typ\.?|sim\.?|do not enter|exit|entry|elev\.?|fdn\.?|f\.d\.?|sect\.?|sect|stair|stairs|hold|hatch")
TITLE_WORDS = (
    r"stamp|consultant|consultants?|architect|engineer|drawn|checked|approved|reviewed|sheet|drawing|project number|"
    r"building number|location|issue date|revision|revisions?|description|date|date:|of record|"
    r"finish plan general notes|general notes|no work|no work this area|finish plan|reflected ceiling plan|"
    r"abbreviations?|room finish legend|abbreviation|construction documents?|prebid|addendum|revision set|"
    r"first floor|second floor|third floor|saint cloud|st cloud|st\. cloud|key plan")
MATERIALS = "p|pt|cpt|vct|wsf|cg|act|gwb|cmu|wb|gyp|hm|wd|mtl|sst|alm|alm\\.?|gl|gl\\.?"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
CERTAIN_ROOMS = (
    "LIVING KITCHEN BEDROOM MASTER DINING FAMILY GREAT FOYER ENTRY HALL HALLWAY CORRIDOR OFFICE DEN STUDY NOOK MEDIA "
    "BONUS REC RECREATION GUEST PLAYROOM BATH BATHROOM RESTROOM TOILET POWDER LAUNDRY MUDROOM MUD LOBBY RECEPTION STAFF "
    "PATIENT EXAM CONF LOUNGE PORCH DECK PATIO BALCONY GARAGE SUNROOM BREAKFAST MORNING SHOP BASEMENT ATTIC CELLAR")
#: smallest believable room in square feet; the first matching class decides
MIN_ROOM_SQFT = [
    (80, "LIVING MASTER GREAT FAMILY REC RECREATION MEDIA BONUS GUEST PLAYROOM GARAGE SHOP LOBBY BASEMENT"),
    (60, "KITCHEN DINING BEDROOM DEN STUDY OFFICE LOUNGE SUNROOM BREAKFAST MORNING CONF EXAM"),
    (30, "NOOK MUDROOM MUD LAUNDRY FOYER ENTRY RECEPTION STAFF PATIENT"),
    (15, "BATH BATHROOM RESTROOM POWDER CLOSET TOILET HALL HALLWAY CORRIDOR VESTIBULE ATTIC CELLAR"),
    (18, "PORCH DECK PATIO BALCONY"),
]
#: paper inches of an imperial scale note
SCALE_INCHES = {
    "1/64": 1 / 64, "1/32": 1 / 32, "3/64": 3 / 64, "1/16": 1 / 16, "3/32": 3 / 32, "1/8": 1 / 8, "5/32": 5 / 32,
    "3/16": 3 / 16, "1/4": 1 / 4, "5/16": 5 / 16, "3/8": 3 / 8, "1/2": 1 / 2, "3/4": 3 / 4, "1": 1.0, "3": 3.0,
}
FOOT, INCH = "['‘’′]", "[\"“”″]"
# --- fixed values: patterns -------------------------------------------------------------------
_CODE = r"[A-Z]{1,3}\s*-?\s*\d{1,3}[A-Z]?"
HEADER_WORD = r"(?i)^(client|date|job\s*#?|sheet|project|drawn|scale|north|key|legend|notes?):?$"
HEADER_DATE = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}$"
HEADER_NUMBERED = r"(?i)^(job|sheet|drawing|project)\s*#?:?\s*[\w-]+$"
BARE_NUMBER = r"^\d[\d.,]*$"
TABLE_HEADING = r"(?i)^(room|dimensions?|size|area|name)$"
BULLET = r"^[•·\-*]"
BEDROOM_COUNT = r"(?i)^\d+\s+(bedroom|bed|br)(\s*(\+|and|and a)\s+(den|flex|study))?$"
AREA_LINE = r"(?i)\b(interior|balcony|total|garage|usable|saleable)\s+area$"
LIST_NUMBER = r"^\d{1,2}\.$"
MEASURE = r"^\d+(['\"’”′″]|\s*(SF|sqft))"
ROOM_NUMBER = r"(?i)^[A-Z]{0,3}\s*\d{2,4}[A-Z]?$"
SHEET_CODE = r"(?i)^(a|af|s|m|e|p|c|l|t)[a-z]?\d{2,4}[a-z]?$"
NUMBERS_ONLY = "^[\\d'\"\\-.,×x\\s]+$"
WEB_ADDRESS = "^https?://"
STREET_NUMBER = r"(?i)^\d+\s+[A-Z]"
CODE_LIST = r"(?i)^([a-z]{1,4}\s*-?\s*\d+)(\s*/\s*[a-z]{1,4}\s*-?\s*\d+)+$"
GRID_LETTER = r"^[A-Z]{1,2}$"
METRIC_SCALE = r"(?i)(?:scale\s*[:=]?\s*)?1\s*:\s*(\d{2,4})\b"
DIM_FEET = rf"^(\d{{1,3}}){FOOT}(\d{{1,2}})?{INCH}?[xX×](\d{{1,3}}){FOOT}(\d{{1,2}})?{INCH}?$"
DIM_PLAIN = r"^(\d{1,3}(?:\.\d+)?)[xX×](\d{1,3}(?:\.\d+)?)$"
CALLOUT_BOTH = rf"^(\d{{1,3}})\s*{FOOT}\s*[-–]?\s*(\d{{1,2}})(?:\s+(\d+)\s*/\s*(\d+))?\s*{INCH}?$"
CALLOUT_FEET = rf"^(\d{{1,3}})\s*{FOOT}\s*(?:-?\s*0\s*{INCH}?)?$"
CALLOUT_INCHES = rf"^(\d{{1,2}})(?:\s+(\d+)\s*/\s*(\d+))?\s*{INCH}$"
BAR_LABEL = rf"^\s*(\d{{1,3}})\s*(?:{FOOT}|\s*(?:ft|FT|Ft))?\s*$"
IMPERIAL_SCALE = (rf"(?i)(\d{{1,2}}(?:\s*/\s*\d{{1,3}})?|\d+\s+\d+\s*/\s*\d+)\s*{INCH}?\s*=\s*(\d+)\s*['’′]\s*"
                  rf"(?:[-–]\s*(\d+)\s*{INCH}?)?")


def has_word(text: Column, words: str) -> Column:
    return text.rlike(r"(?i)\b(" + "|".join(words.split()) + r")\b")


def is_whole(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i)^({pattern})$")


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    """Capture groups as text; an absent group is ''."""
    return [F.regexp_extract(text, pattern, i) for i in range(1, n + 1)]


def _numbers(text: Column, pattern: str, n: int) -> list[Column]:
    """Capture groups as numbers; an absent group is NULL, without evaluating the pattern twice."""
    return [g.try_cast("double") for g in _groups(text, pattern, n)]


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, which keeps generated code small."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _bind(columns: list[Column], fn) -> Column:
    """``fn`` over several columns, each computed once."""
    names = [f"g{i}" for i in range(len(columns))]
    packed = F.struct(*[col.alias(n) for n, col in zip(names, columns)])
    return let(packed, lambda v: fn(*[v[n] for n in names]))


# --- dimensions --------------------------------------------------------------------------------
def parse_dim(text: Column) -> Column:
    """Width and height in feet of ``12'6" x 10'`` or ``12 x 10.5``; NULL otherwise."""
    feet = DIM_FEET
    plain = DIM_PLAIN
    zero = F.lit(0.0)

    def size(w, wi, h, hi, pw, ph):
        return F.struct(F.coalesce(w + F.coalesce(wi, zero) / 12, pw).alias("width_ft"),
                        F.coalesce(h + F.coalesce(hi, zero) / 12, ph).alias("height_ft"))

    def checked(d):
        w, h = d["width_ft"], d["height_ft"]
        return F.when((w > 0) & (h > 0) & (w < 200) & (h < 200), d)

    return let(F.regexp_replace(text, r"\s+", ""), lambda t: let(
        _bind([*_numbers(t, feet, 4), *_numbers(t, plain, 2)], size), checked))


def parse_callout(text: Column) -> Column:
    """Length in feet and confidence of a single dimension note; NULL otherwise."""
    both = CALLOUT_BOTH
    only = CALLOUT_FEET
    short = CALLOUT_INCHES

    def part(n: Column, d: Column) -> Column:
        return F.coalesce(F.when(d > 0, n / d), F.lit(0.0))

    def hit(cond: Column, length: Column, confidence: float) -> Column:
        return F.when(cond, F.struct(length.alias("length_ft"), F.lit(confidence).alias("confidence")))

    def read(ft, inch, n, d, feet, whole, n2, d2):
        return F.coalesce(
            _bind([inch + part(n, d)], lambda i: hit(i < 12, ft + i / 12, 0.99)),
            hit(feet > 0, feet, 0.95),
            _bind([whole + part(n2, d2)], lambda i: hit((i > 0) & (i < 36), i / 12, 0.7)))

    return let(F.trim(text), lambda t: F.when(
        F.length(t).between(1, 30) & ~t.rlike("(?i)[=:]|scale"),
        _bind([*_numbers(t, both, 4), *_numbers(t, only, 1), *_numbers(t, short, 3)], read)))


def orientation(rotation: Column) -> Column:
    """``h`` or ``v`` within 0.3 rad of an axis, else NULL."""
    r = F.pmod(rotation, F.lit(2 * math.pi))
    near = lambda angle: F.abs(r - angle) < 0.3
    return (F.when((r < 0.3) | near(math.pi) | near(2 * math.pi), "h")
            .when(near(math.pi / 2) | near(3 * math.pi / 2), "v"))


# --- scales --------------------------------------------------------------------------------------
def _scale(pt: Column, label: Column, kind: str, confidence: Column) -> Column:
    return F.struct(pt.alias("pt_per_foot"), label.alias("label"), F.lit(kind).alias("kind"),
                    confidence.alias("confidence"))


def imperial_scale(text: Column) -> Column:
    """``1/8" = 1'-0"`` as points per foot.

    Compatibility: blanks are removed before the fraction is looked up, so a mixed number such as
    ``1 1/2`` is not recognised.
    """
    pattern = IMPERIAL_SCALE
    table = F.create_map(*[F.lit(x) for kv in SCALE_INCHES.items() for x in kv])

    def read(key, ft, inch, word):
        inches = F.coalesce(inch, F.lit(0.0))
        pt = F.lit(12.0 * 72.0) * F.try_element_at(table, key) / (ft * 12 + inches)
        label = F.concat(key, F.lit('" = '), ft.cast("int").cast("string"), F.lit("'-"),
                         inches.cast("int").cast("string"), F.lit('"'))
        return F.when((ft > 0) & pt.between(1, 1000),
                      _scale(pt, label, "imperial", F.when(word, 0.92).otherwise(0.75)))

    return let(F.trim(text), lambda t: F.when(F.length(t).between(1, 60), _bind(
        [F.regexp_replace(_groups(t, pattern, 1)[0], r"\s", ""), *_numbers(t, pattern, 3)[1:],
         t.rlike(r"(?i)\bscale\b")], read)))


def metric_scale(text: Column) -> Column:
    pattern = METRIC_SCALE

    def read(n, word):
        label = F.concat(F.lit("1:"), n.cast("int").cast("string"))
        return F.when(n.between(10, 5000), _scale(F.lit(863.6) / n, label, "metric",
                                                  F.when(word, 0.9).otherwise(0.6)))

    return let(F.trim(text), lambda t: F.when(F.length(t).between(1, 60), _bind(
        [*_numbers(t, pattern, 1), t.rlike(r"(?i)\bscale\b")], read)))


def feet_label(text: Column) -> Column:
    """Number printed on a scale bar, 0..500 feet."""
    (v,) = _groups(text, BAR_LABEL, 1)
    n = v.try_cast("int")
    return F.when(n <= 500, n)


def two_point_scale(x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column,
                    feet: Column) -> Column:
    """Points per foot of a two-click calibration; NULL below 6 pt or for a bad length."""
    dist = F.hypot((x2 - x1) * page_w, (y2 - y1) * page_h)
    return F.when((feet > 0) & (page_w > 0) & (page_h > 0) & (dist >= 6), dist / feet)


def scale_accepted(method: Column, confidence: Column) -> Column:
    """(accepted, warn): printed notes pass at .45, others at .6; below .6 comes a warning (C20)."""
    accepted = confidence >= F.when(method == "text-notation", 0.45).otherwise(0.6)
    return F.struct(accepted.alias("accepted"), (accepted & (confidence < 0.6)).alias("warn"))


# --- labels --------------------------------------------------------------------------------------
def is_header(text: Column) -> Column:
    """Dates, job numbers, bare numbers and table headings are never labels."""
    t = F.trim(text)
    return ((t == "") | t.rlike(HEADER_WORD)
            | t.rlike(HEADER_DATE)
            | t.rlike(HEADER_NUMBERED) | t.rlike(BARE_NUMBER)
            | t.rlike(TABLE_HEADING))


def is_table_room(text: Column) -> Column:
    """Room label for the table and vector extractors."""
    t = F.trim(text)
    return (F.length(t).between(2, 40) & ~t.rlike(BULLET) & (F.size(F.split(t, r"\s+")) <= 4)
            & ~t.rlike(BEDROOM_COUNT)
            & ~t.rlike(AREA_LINE)
            & ~is_header(t) & parse_dim(t).isNull() & ~is_whole(t, _CODE)
            & ~has_word(t, NO_ROOM_TABLE) & has_word(t, ROOM_WORDS_TABLE))


def is_candidate_room(text: Column) -> Column:
    """Room label for the candidate extractor: a room word or a room number (C11)."""
    t = F.trim(text)
    return ((t != "") & ~t.rlike(LIST_NUMBER) & ~t.rlike(MEASURE)
            & ~has_word(t, NO_ROOM_CANDIDATE) & ~is_whole(t, _CODE)
            & (has_word(t, ROOM_WORDS_CANDIDATE) | t.rlike(ROOM_NUMBER)))


def is_title_word(text: Column) -> Column:
    """Title-block words, dates and sheet codes."""
    t = F.trim(text)
    return (is_whole(t, TITLE_WORDS) | t.rlike(rf"(?i)^({MONTHS})\s+\d{{1,2}},?\s+\d{{4}}$")
            | t.rlike(SHEET_CODE))


def may_be_label(text: Column, x_norm: Column, y_norm: Column) -> Column:
    """Label for the permissive picker, before title-block strips are taken out."""
    t = F.trim(text)
    return (F.length(t).between(2, 40) & ~t.rlike(NUMBERS_ONLY) & ~t.rlike(WEB_ADDRESS)
            & ~(t.rlike(STREET_NUMBER) & (F.length(t) > 12)) & y_norm.between(0.04, 0.97)
            & x_norm.between(0.02, 0.98) & ~is_whole(t, ANNOTATIONS)
            & ~t.rlike(rf"(?i)^({MATERIALS})\s*-?\s*\d+([\s/-]?\d+)?$")
            & ~t.rlike(CODE_LIST)
            & ~t.rlike(GRID_LETTER) & ~is_title_word(t) & t.rlike("[A-Za-z]{2,}"))


def in_margin(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Centre in the outer 2 % of the page (C14)."""
    return ~((x + w / 2) / page_w).between(0.02, 0.98) | ~((y + h / 2) / page_h).between(0.02, 0.98)


def is_interior(text: Column) -> Column:
    from plumbline.refdata import OUTDOOR_WORDS
    return ~has_word(text, " ".join(OUTDOOR_WORDS))


def is_certain_room(label: Column) -> Column:
    """The label names a habitable room beyond doubt."""
    return has_word(label, CERTAIN_ROOMS)


def min_room_sqft(label: Column) -> Column:
    expr = None
    for sqft, words in MIN_ROOM_SQFT:
        cond = has_word(label, words)
        expr = F.when(cond, sqft) if expr is None else expr.when(cond, sqft)
    return expr.otherwise(0)
