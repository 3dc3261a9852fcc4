"""Fixed values of the engine, stated once."""

# Thresholds and bands.
SIMILARITY_THRESHOLD, HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.75, 0.90, 0.75
STATUS_BANDS = (("resolved", 0.95), ("accepted", 0.82), ("review", 0.75))
FALLBACK_STATUS = "conflict"
UNSPECIFIED, UNKNOWN = "UNSPECIFIED", "unknown"
# Cells that mean "nothing here".
PLACEHOLDERS = ("", "-", "--", ".", "?", "??", "NA", "N/A", "NAN", "NONE", "NULL", "NIL", "UNKNOWN", "UNSPECIFIED", "ERROR", "#N/A", "#NA", "#REF!", "#VALUE!", "TBD", "XX", "XXX", "0")
# Expansions, in order.
NORMALIZATION_RULES = ((r"\bS\.?S\.?\b", "STAINLESS STEEL"), (r"\bC\.?S\.?\b", "CARBON STEEL"), (r"\bM\.?S\.?\b", "MILD STEEL"), (r"\bDIA\b", "DIAMETER"), (r"\bAPPX\b", "APPROXIMATE"))
# Dimension, canonical unit, spellings.
UOM_TABLE = (
    ("count", "EACH", "EA EACH EAC NO NOS NUMBER NUMBERS PC PCS PIECE PIECES UNIT UNITS U N"),
    ("count", "SET", "SET SETS ST STS"),
    ("count", "PAIR", "PAIR PAIRS PR PRS"),
    ("count", "DOZEN", "DOZ DOZEN DZ DZN"),
    ("count", "PACK", "PACK PACKS PKT PKTS PACKET PACKETS PKG"),
    ("count", "BOX", "BOX BOXES BX CTN CARTON CARTONS CASE"),
    ("count", "ROLL", "ROLL ROLLS RL COIL COILS"),
    ("count", "DRUM", "DRUM DRUMS DRM BARREL BARRELS BBL"),
    ("count", "BAG", "BAG BAGS BG SACK SACKS"),
    ("count", "BOTTLE", "BTL BOTTLE BOTTLES CAN CANS TIN TINS"),
    ("count", "TUBE", "TUBE TUBES TB"),
    ("count", "REAM", "REAM REAMS RM"),
    ("mass", "KG", "KG KGS KILO KILOS KILOGRAM KILOGRAMS KGM"),
    ("mass", "G", "G GM GMS GRAM GRAMS"),
    ("mass", "TONNE", "TON TONS TONNE TONNES MT T"),
    ("mass", "QUINTAL", "QTL QUINTAL QUINTALS"),
    ("length", "M", "M MTR MTRS MTS METER METERS METRE METRES"),
    ("length", "CM", "CM CMS CENTIMETER CENTIMETRE"),
    ("length", "MM", "MM MMS MILLIMETER MILLIMETRE"),
    ("length", "KM", "KM KMS KILOMETER KILOMETRE"),
    ("length", "FT", "FT FEET FOOT"),
    ("length", "INCH", 'IN INCH INCHES "'),
    ("length", "YARD", "YD YARD YARDS YDS"),
    ("volume", "L", "L LT LTR LTRS LIT LITRE LITRES LITER LITERS"),
    ("volume", "ML", "ML MLS MILLILITRE MILLILITER"),
    ("volume", "KL", "KL KLTR KILOLITRE KILOLITER"),
    ("volume", "M3", "M3 CUM CBM CUBICMETER CUBICMETRE"),
    ("area", "M2", "M2 SQM SQMT SQUAREMETER SQUAREMETRE"),
    ("area", "FT2", "FT2 SQFT SQUAREFEET SQUAREFOOT"),
    ("time", "HOUR", "HR HRS HOUR HOURS"),
    ("time", "DAY", "DAY DAYS DY"),
    ("time", "MONTH", "MON MONTH MONTHS MTH"),
    ("service", "JOB", "JOB JOBS LOT LS LUMPSUM LUMPSUMP AU ACT"),
)
# Cells that mean no unit of measure.
UOM_BLANKS = ("", "-", "--", "NA", "NIL", "NONE", "NULL", "UNKNOWN", "?", "VALUE", "REF", "DIV0", "0", "XX", "TBD", "BLANK")
# When a unit's prices, a spread or a seam are worth a look.
MIN_ROWS_FOR_UNIT_OUTLIER, UNIT_OUTLIER_RATIO, SUSPECT_SPREAD_RATIO = 5, 1.25, 20.0
# Words of a description that never name a class.
CODE_STOPWORDS = (
    "AND OR OF FOR WITH TO THE A AN IN ON TYPE SIZE GRADE CLASS MAKE MODEL SERIES SET NEW OLD OBSOLETE SPARE SPARES ASSY ASSEMBLY "
    "HEAVY LIGHT SMALL LARGE LONG SHORT STD STANDARD MM CM INCH NB OD ID DIA THK LG"
).split()
# Materials, forms and finishes.
CODE_MODIFIERS = (
    "STAINLESS STEEL SS SS304 SS316 MS CS GI CI BRASS BRONZE COPPER ALUMINIUM ALUMINUM ALLOY IRON RUBBER NITRILE NEOPRENE PTFE TEFLON "
    "NYLON PVC HDPE LDPE GRAPHITE CERAMIC GLASS PLASTIC CARBON GALVANISED GALVANIZED CHROME NICKEL ZINC TITANIUM "
    "HEX HEXAGON HEXAGONAL HEXAGONL SQUARE ROUND FLAT SPIRAL SPRL WOUND WND SW THREADED PLAIN SLOTTED COUNTERSUNK CSK PAN CAP SOCKET HD "
    "HEAD FULL HALF DOUBLE SINGLE HEAVYDUTY WHITE BLACK YELLOW BLUE RED GREEN RATCHET"
).split()
CODE_PREFIX, CODE_FALLBACK, CODE_SLUG, CODE_MIN_FAMILIES = "MTL", "GEN", 5, 2
SPLIT_WEAK_GAP, ACCEPT_FLOOR = 0.10, 0.82
# First bytes of files that aren't text.
BINARY_SIGNATURES = (
    ("89504E47", "a PNG image"), ("FFD8FF", "a JPEG image"), ("47494638", "a GIF image"), ("25504446", "a PDF"),
    ("504B0304", "a ZIP or Office file (.xlsx, .docx)"), ("D0CF11E0", "a legacy Office file (.xls, .doc)"), ("1F8B", "a gzip archive"),
    ("52617221", "a RAR archive"), ("7F454C46", "a binary executable"), ("424D", "a bitmap image"),
)
VERBS, MAX_NAME, REVERSIBLE_ROWS, KEEP_RUNS = ("approve", "split", "merge"), 64, 20_000, 40
# Limits of drawings, previews and pages.
GRAPH_FAMILIES, GRAPH_BUDGET = 900, 6000
PREVIEW_SPELLINGS, PAGE_SPELLINGS, MANY_SPELLINGS, SHOWN_CODES, SAMPLE_LENGTH = 12, 12, 6, 3, 160
FAN_IN_MEMBERS, UNIT_RAIL, SHOWN_CLASSES, UNRECOGNISED_UNITS, EXAMPLES, EXAMPLE_SAMPLES, EXAMPLE_LENGTH = 4, 40, 12, 12, 6, 4, 110
NEAR_MISS_LOW, NEAR_MISS_HIGH, NEAR_MISSES = 0.55, 0.75, 36
MAX_QUESTION, MIN_QUESTION, MAX_ASKER, MAX_ADDRESS = 1000, 5, 80, 160
# Seconds between calls of a model, tries, the longest wait, and answers that are worth another try.
CALL_SECONDS, CALL_TRIES, LONGEST_WAIT, RETRY_CODES = 3.2, 4, 30.0, (429, 500, 502, 503)
MAX_HEADER_SCAN, MIN_TABLE_COLUMNS = 20, 2
# Column names that are a role's own.
ROLE_NAMES = {
    "description": ("Description", "Material Description", "Material_Description", "MaterialDescription", "Item Description", "Item_Description", "Long Description", "Short Text", "Material Text"),
    "unit": ("CPSE", "CPSE Name", "CPSE_Name", "Organization", "Organisation", "Company", "Business Unit", "Owning Unit", "Source", "Plant", "Refinery"),
    "code": ("Material Code", "Material_Code", "MaterialCode", "Code", "Item Code", "Item_Code", "Material Number", "Material_Number"),
}
# Words of a column name that speak for a role, and how much.
ROLE_TOKENS = {
    "description": {
        "description": 6.0, "desc": 5.0, "material text": 5.0, "short text": 5.0, "long text": 4.0, "item text": 4.0, "text": 2.0, "nomenclature": 5.0, "particular": 4.0, "narration": 3.5,
        "itemname": 4.0, "item name": 4.0, "material": 2.0, "item": 1.5, "name": 1.0, "title": 1.0, "spec": 1.5, "maktx": 6.0, "maktg": 5.0, "txz01": 4.5,
    },
    "unit": {
        "cpse": 6.0, "organisation": 5.0, "organization": 5.0, "company": 4.5, "source_system": 5.0, "source system": 5.0, "sourcesystem": 5.0, "business unit": 4.5, "owning unit": 4.5,
        "refinery": 4.0, "plant": 3.5, "location": 3.0, "entity": 3.5, "division": 3.0, "site": 3.0, "source": 3.0, "system": 2.5, "org": 2.5, "unit": 1.0, "depot": 3.0, "werks": 5.0, "bukrs": 5.0,
    },
    "price": {
        "unit price": 6.0, "unit_price": 6.0, "unitprice": 6.0, "rate": 5.0, "price": 5.5, "amount": 4.0, "value": 3.0, "cost": 5.0, "landed": 4.0, "net price": 5.5, "po value": 4.5,
        "inr": 2.0, "rupees": 2.5, "usd": 1.5, "netpr": 4.5, "peinh": 2.0,
    },
    "code": {
        "material code": 6.0, "material number": 6.0, "matnr": 6.0, "item code": 5.5, "item_code": 5.5, "material_code": 6.0, "part number": 5.0, "sku": 4.5, "code": 3.5, "number": 2.0,
        "no.": 1.5, "id": 1.5, "ref": 1.5, "bismt": 4.0,
    },
    "measure": {
        "uom": 6.0, "unit of measure": 6.0, "unitofmeasure": 6.0, "u/m": 5.0, "base unit": 5.0, "baseunit": 5.0, "order unit": 4.5, "issue unit": 4.5, "stock unit": 4.5, "measure": 4.0,
        "uom code": 5.0, "meins": 6.0, "bstme": 4.5, "unit": 1.5,
    },
    "label": {
        "gold": 6.0, "ground truth": 6.0, "groundtruth": 6.0, "truth": 5.0, "label": 5.0, "verified": 4.5, "confirmed": 4.0, "approved": 3.5, "true group": 6.0, "true_group": 6.0, "correct": 4.0,
        "canonical": 3.0, "master code": 3.5, "parent": 2.5, "cluster": 3.0, "group": 2.5, "dedup": 4.5, "duplicate of": 5.0, "same as": 4.5,
    },
}
# Cells that show a column holds units of measure.
UOM_CELLS = (
    "NOS NO NOS. PCS PC PIECE PIECES EA EACH SET SETS PAIR BOX PKT PACK KG KGS GM GRAM TON MT LTR LTRS LITRE LITER ML MTR MTRS METER METRE CM MM INCH FT SQM CUM "
    "ROLL COIL DRUM BAG BTL BOTTLE CAN TUBE REAM DOZ DOZEN UNIT"
).split()
LABEL_MIN_GROUPS, LABEL_MAX_DISTINCT, LABEL_MIN_COVERAGE = 2, 0.92, 0.60
UNATTRIBUTED = "unattributed"
PAGE_FAMILIES = 50
# The fields of a standard description, in order, and cells that stand for none.
STANDARD_FIELDS = ("item", "type", "material", "size", "rating", "standard")
NULL_WORDS = ("null", "none", "n/a")
FAMILIES_PER_CALL, STANDARDS_PER_CALL, PAIRS_PER_CALL, ASKED_FAMILIES, ASKED_LINES = 6, 10, 12, 60, 8
