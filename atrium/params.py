"""Fixed values of the venue model: every tunable of the operators, in one place."""

# Palette of the drawing's legend, in the order in which a colour is matched.
PALETTE = (
    ((187, 230, 251), "estande", "expositor"),
    ((237, 33, 36), "area", "cultural"),
    ((250, 238, 19), "estande", "patrocinador"),
    ((179, 127, 184), "estande", "entidade"),
    ((192, 226, 202), "area", "infra"),
    ((250, 163, 26), "area", "alimentacao"),
)
# Colours that stand for another, greys of the floor, the street colour, access triangles.
ALIASES = (((235, 32, 40), (237, 33, 36)), ((238, 163, 26), (250, 163, 26)))
GREYS = ((198, 199, 200), (128, 129, 129), (35, 31, 32))
STREET = (198, 177, 152)
POI_COLOURS = (
    ((9, 146, 71), "entrada"),
    ((97, 186, 87), "entrada"),
    ((205, 75, 147), "entrada-bilheteria"),
    ((225, 114, 38), "entrada-expositor"),
    ((235, 44, 41), "saida"),
    ((237, 33, 36), "saida"),
    ((55, 185, 235), "escolas"),
)
SNAP_TOL = 18
CODE_RE = r"^[A-Z]{1,3}\d{1,3}[A-Z]?$"
STREET_RE = r"(?i)^RUA\s+[A-Z]{1,2}"
POI_WORDS_RE = r"(?i)^(ENTRADA|SA[ÍI]DA|ACESSO)"

# The numbers of the model.
M_PER_POINT = 0.194875
RING_MIN_AREA = 0.4
POI_MAX_AREA, POI_MAX_VERTICES = 4.0, 4
BOOTH_MAX_AREA = 3.0
STRIP_SHORT, STRIP_RATIO = 1.8, 2.5
MIN_AREA, MIN_AREA_OF_AREA = 1.0, 5.0
LABEL_MIN_SIZE = 0.9
POI_LABEL_RADIUS = 8.0

MIN_SHAPE_AREA, MINI_AREA = 0.5, 6.0
CLOSING_M, WIDTH_MIN, WIDTH_MAX, WIDTH_OPEN, APRON_M = 12, 2, 12, 20, 6
SAMPLE_M, CENTRE_TOL, GAP_M = 1.0, 1.5, 14
LENGTH_MIN, LENGTH_ANON, PIECE_NEAR = 12, 20, 0.6

ACCESS_REACH = 4.0
COMFORT_M, WALL_PENALTY, SIMPLIFY_MAX = 3.0, 0.35, 1.0
SNAP_LIMIT = 25.0
TURN_MIN, WAY_SLACK, WAY_COVERAGE, WAY_SAMPLES, SHORT_M, WAY_DEFAULT_WIDTH = 30.0, 3.0, 0.7, 16, 12.0, 4.0
MAX_STOPS, EXHAUSTIVE_UPTO, M_PER_MIN, ACCEPT_GAIN = 8, 7, 75, 0.5
SEARCH_LIMIT = 30
#: A visitor who gives no command for so long is taken to have left.
IDLE_S = 1800.0
IOU_MIN, MODULE_SIDE = 0.98, (0.5, 40.0)
METRES_PER_DEGREE = 111320.0
ISOTROPY, BASELINE_RATIO, BASELINE_DRIFT_CM = 0.05, 0.01, 1.0
SEED_OFFSETS = (-12, -10, -8, -6, -5, -4, 4, 5, 6, 8, 10, 12)
FOOD_COURT = "Praça de Alimentação"

# Conditions of the map's style layers, in drawing order.
LAYERS = {
    "piso": "kind = 'piso'", "piso-borda": "kind = 'piso'", "circulacao": "kind = 'circulacao'", "vias": "kind = 'via'", "areas": "kind = 'area'", "areas-borda": "kind = 'area'",
    "quadras": "kind = 'quadra'", "estandes": "kind = 'estande'", "estandes-borda": "kind = 'estande'",
    "areas-poi": "kind = 'area' and name is not null and cat is distinct from 'servico' and cat is distinct from 'infra'",
    "areas-poi-servico": "kind = 'area' and (cat = 'servico' or cat = 'infra') and (name is not null or cat = 'servico')",
    "pois-entrada": "kind = 'poi'", "ruas-nome": "kind = 'via'", "estandes-nome": "kind = 'estande' and mini is distinct from true",
    "estandes-nome-mini": "kind = 'estande' and mini", "estandes-codigo": "kind = 'estande' and name is not null",
}

# Colours of the older map, the first within the tolerance counts.
LEGACY_STANDS = (((187, 230, 251), "expositor"), ((250, 238, 19), "patrocinador"), ((255, 242, 0), "patrocinador"), ((179, 127, 184), "entidade"))
LEGACY_AREAS = (
    ((235, 32, 40), "cultural"), ((237, 33, 36), "cultural"), ((209, 32, 39), "cultural"), ((250, 163, 26), "alimentacao"), ((247, 148, 29), "alimentacao"),
    ((128, 129, 129), "servico"), ((129, 128, 128), "servico"), ((192, 226, 202), "infra"),
)
LEGACY_PALE, LEGACY_TOL, LEGACY_PALE_TOL, LEGACY_PALE_AREA = (198, 199, 200), 10, 6, 2000.0
# Regions of the older page, in points.
LIST_Y, DECOR_Y, CORNER, LEGEND_BOX, SHAPE_SIDE, EXTRACT_SIDE = 950.0, 105.0, (1270.0, 300.0), (1075.0, 285.0, 1587.4, 490.0), 5.0, 4.0
DECOR_SIDE, DECOR_AREA, MARKER_X, MARKER_CHROMA, MARKER_WIDTH, MARKER_HEIGHT = 8.0, 600.0, 215.0, 55, (3.5, 11.0), (15.0, 85.0)
GRAPH_GAP, GRAPH_ALIGN, GRAPH_APART, GRAPH_OVERLAP, ANNEX_X, ROW_TOL = (8.0, 90.0), 18.0, 120.0, 40.0, 1270.0, 10.0
RESTAURANTS = r"(?i)PIZZA HUT|JOHNNY|SPOLETO|BOALI|BAUDUCCO|LOCKERS|INDIGO"
ARTISTS = "Alameda dos Artistas"
ANNEX_M, ANNEX_RIM, MINI_SIDE = 255.0, 4.0, 2.5
HALL_ROWS, HALL_X, ROW_HIGH, BAND_HIGH, AISLE_WIDE, AISLE_GAP, AISLE_APART = 10, 1015.0, 17.0, 40.0, 20.0, (5.0, 60.0), 12.0
BAND_M, STREET_M, CELL_M, AISLE_M, AISLE_MIN, AISLE_MAX = 10.0, 4.2, 7.4, 5.0, 0.5, 12.0

# Particles that stay in lower case inside a title.
PARTICLES = ("de", "da", "do", "das", "dos", "e", "em", "a", "o")
PARTICLES_MORE = (*PARTICLES, "à", "por")
# Labels of search results.
AREA_LABELS = {"alimentacao": "Alimentação", "cultural": "Espaço cultural", "servico": "Serviços", "infra": "Serviços"}
# Instruction sentences.
TEXT = {
    "start_way": "Siga pela {way} por {m} m", "start": "Siga em frente por {m} m", "change": "Passe para a {way} e siga {m} m",
    "go_way": "Continue pela {way} por {m} m", "go": "Continue em frente por {m} m", "turn_way": "Vire à {side} pela {way} e siga {m} m",
    "turn": "Vire à {side} e siga {m} m", "arrive": "Chegou: {label}", "arrive_plain": "Chegou ao destino",
}
