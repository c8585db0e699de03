"""Schemas of page documents, answer keys, profiles and logs, plus fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(S)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


BBOX = struct(x=D, y=D, width=D, height=D)

TEXT_SPAN = struct(id=S, text=S, confidence=D, confidenceScope=S, parentLineId=S, bbox=BBOX)
BLANK = struct(
    id=S, kind=S, lineBbox=BBOX, interactionBbox=BBOX, detectionMethod=S,
    candidateScore=D, nearbyTextSpanIds=STRINGS,
)
OPTION = struct(id=S, label=S)
CHOICE_GROUP = struct(id=S, options=T.ArrayType(OPTION))
CHOICE_TARGET = struct(
    id=S, kind=S, targetBbox=BBOX, interactionBbox=BBOX, optionGroupId=S,
    detectionMethod=S, candidateScore=D, nearbyTextSpanIds=STRINGS,
)
GRID_CELL = struct(id=S, optionId=S, cellBbox=BBOX, interactionBbox=BBOX)
GRID_ROW = struct(
    id=S, rowBbox=BBOX, promptBbox=BBOX, nearbyTextSpanIds=STRINGS, cells=T.ArrayType(GRID_CELL),
)
CHOICE_GRID = struct(
    id=S, kind=S, gridBbox=BBOX, optionGroupId=S, detectionMethod=S, candidateScore=D,
    rows=T.ArrayType(GRID_ROW),
)
ORDERING_ITEM = struct(id=S, text=S, bbox=BBOX, originalIndex=I)
ORDERING = struct(
    id=S, kind=S, bbox=BBOX, exerciseId=S, promptIndex=I, detectionMethod=S,
    candidateScore=D, nearbyTextSpanIds=STRINGS, items=T.ArrayType(ORDERING_ITEM),
)
MATCHING_ITEM = struct(
    id=S, label=S, text=S, bbox=BBOX, anchorBbox=BBOX, nearbyTextSpanIds=STRINGS,
)
MATCHING = struct(
    id=S, kind=S, bbox=BBOX, detectionMethod=S, candidateScore=D, cardinality=S,
    nearbyTextSpanIds=STRINGS, leftItems=T.ArrayType(MATCHING_ITEM),
    rightItems=T.ArrayType(MATCHING_ITEM),
)
FREE_TEXT_LINE = struct(id=S, bbox=BBOX)
FREE_TEXT = struct(
    id=S, kind=S, bbox=BBOX, detectionMethod=S, candidateScore=D,
    nearbyTextSpanIds=STRINGS, responseLines=T.ArrayType(FREE_TEXT_LINE),
)
SEMANTIC_EXERCISE = struct(
    id=S, number=S, title=S, instruction=S, kind=S, bbox=BBOX, sourceOrder=I,
    interactionIds=STRINGS, contextSpanIds=STRINGS, detectionMethod=S, confidence=D,
)
DETECTION = struct(
    detectionMethod=S, rawCandidateCount=I, acceptedCount=I, groupCount=I, durationMs=I,
)
PROCESSOR = struct(
    engine=S, engineVersion=S, model=S, language=S, parameters=T.MapType(S, S),
    processedAt=T.TimestampType(), durationMs=I,
)

# array-valued fields of a page document, in document order
DOCUMENT_ARRAYS = {
    "textSpans": TEXT_SPAN,
    "exerciseBlanks": BLANK,
    "choiceGroups": CHOICE_GROUP,
    "choiceTargets": CHOICE_TARGET,
    "choiceGrids": CHOICE_GRID,
    "sentenceOrderings": ORDERING,
    "matchingInteractions": MATCHING,
    "freeTextInteractions": FREE_TEXT,
    "semanticExercises": SEMANTIC_EXERCISE,
}
DETECTION_FIELDS = [
    "blankDetection", "choiceDetection", "choiceGridDetection",
    "sentenceOrderingDetection", "matchingDetection", "freeTextDetection",
]
PAGE_DOCUMENT = struct(
    schemaVersion=S, pageNumber=I, width=I, height=I, language=S,
    **{name: T.ArrayType(t) for name, t in DOCUMENT_ARRAYS.items()},
    **{name: DETECTION for name in DETECTION_FIELDS},
    processor=PROCESSOR,
)

PAIR = struct(leftLabel=S, rightLabel=S)
TYPED_PAYLOAD = struct(
    type=S, value=S, alternatives=STRINGS, pairs=T.ArrayType(PAIR), modelText=S, sourceHint=S,
)
KEY_ENTRY = struct(
    pageNumber=I, exerciseNumber=S, unitNumber=I, subExerciseMarker=S, items=STRINGS,
    interactionKind=S, ordinal=I, expectedValue=S, alternatives=STRINGS, caseSensitive=B,
    punctuationRequired=B, normalizationMode=S, rawSolutionText=S, confidence=D,
    mappingWarnings=STRINGS, typedPayload=TYPED_PAYLOAD,
)
PAGE_RANGE = T.StructType([T.StructField("from", I), T.StructField("to", I)])
UNIT = struct(unitNumber=I, title=S, printedStartPage=I)
PROFILE_METADATA = struct(
    printedPageOffset=I, units=T.ArrayType(UNIT), loesungenPdfRange=PAGE_RANGE,
    nonUnitPrintedRanges=T.ArrayType(PAGE_RANGE),
)

# Interaction kinds in resolution order, as (interaction kind,
# answer-key kind, lesson/answer-store kind).
KINDS = [
    ("fill-in-line", "FillBlank", "fill-blank"),
    ("choice", "Choice", "choice"),
    ("choice-grid", "ChoiceGrid", "choice-grid"),
    ("sentence-ordering", "SentenceOrdering", "sentence-ordering"),
    ("matching", "Matching", "matching"),
    ("free-text", "FreeText", "free-text"),
]
KIND_ORDER = [k for k, _, _ in KINDS]
KEY_KIND_TO_INTERACTION = {key: kind for kind, key, _ in KINDS}
INTERACTION_TO_STORE_KIND = {kind: store for kind, _, store in KINDS}

# Processing stages, in pipeline order.
PAGE_STAGES = [
    "UPLOADED", "PENDING", "RASTERIZING", "OCR", "DETECTING_INTERACTIONS",
    "PERSISTING", "READY", "FAILED",
]
ACTIVE_STAGES = ["PENDING", "RASTERIZING", "OCR", "DETECTING_INTERACTIONS", "PERSISTING"]
STATUS_RENAMES = {"PROCESSING": "OCR", "DETECTING_BLANKS": "DETECTING_INTERACTIONS"}
SCHEMA_VERSION = "0.2.0"
