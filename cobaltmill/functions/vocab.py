"""Fixed word lists, catalogs and thresholds. These values define the results; keep them as they are."""

from __future__ import annotations

# --- fixed values: header detection ------------------------------------------------------------
HEADER_KEYWORDS = (
    "fob", "cif", "aduana", "arancel", "nandina", "partida", "importacion", "importación",
    "exportacion", "exportación", "origen", "destino", "pais", "país", "declaracion",
    "declaración", "dian", "subpartida", "descripcion", "descripción", "factura", "valor", "peso",
    "unidades", "cantidad", "proveedor", "empresa", "nit", "razon", "razón", "social", "modalidad",
    "regimen", "régimen", "puerto", "periodo", "período", "año", "mes", "fecha", "numero",
    "número", "código", "codigo", "total", "tipo", "nombre", "ciudad", "departamento",
    "municipio", "clase", "identificacion", "identificación", "producto", "item", "ítem",
    "referencia",
)
HEADER_SCAN_ROWS = 24
TRANSACTION_HEADER_KEYWORDS = (
    "cif", "fob", "cantidad", "arancel", "aduana", "fecha", "nit", "valor", "total",
    "descripcion", "documento", "factura", "concepto", "debito", "credito", "saldo",
)
TRANSACTION_SCAN_ROWS = 12

# --- fixed values: thresholds ------------------------------------------------------------------
SPLIT_DENSITY = 0.60
ID_DENSITY = 0.70
NUMERIC_PARSE_RATE = 0.35
FUZZY_SCORE = 85
SPLIT_MARKS = ("|", ";")

# --- fixed values: column-name hints -----------------------------------------------------------
ID_HINTS = ("nit", "cédula", "cedula", "identificacion", "identificación", "documento")
COP_HINTS = (
    "cop", "peso", "pesos", "costo", "flete", "seguro", "valor", "monto", "importe", "total",
)
USD_HINTS = ("usd", "dolar", "dólar", "us$", "u$s", "dollars")
CRITICAL_HINTS = (
    "valor", "cif", "fob", "monto", "importe", "precio", "total", "flete", "seguro",
)
ADDITIVE_HINTS = ("flete", "seguro", "gasto", "costo", "cargo", "impuesto")
DATE_HINTS = ("fecha", "presentacion", "presentación", "declaracion", "declaración")
CHART_DATE_HINTS = (
    "fecha", "date", "mes", "month", "año", "year", "periodo", "period", "semana", "trimestre",
    "quarter",
)
QUANTITY_HINTS = (
    "qty", "quantity", "value", "amount", "demand", "units", "venta", "cantidad", "total", "suma",
)
AGGREGATED_TABLE_NAMES = (
    "resumen", "resultado", "summary", "result", "top", "ranking", "grouped", "agrupado",
    "ventas_por", "totales", "conteo",
)

# --- fixed values: reference catalogs ----------------------------------------------------------
CATALOGS: dict[str, tuple[str, ...]] = {
    "ciudades": (
        "BOGOTA", "MEDELLIN", "CALI", "BARRANQUILLA", "CARTAGENA", "BUCARAMANGA", "PEREIRA",
        "MANIZALES", "CUCUTA", "IBAGUE", "SANTA MARTA", "VILLAVICENCIO", "ARMENIA", "NEIVA",
        "POPAYAN", "VALLEDUPAR", "MONTERIA", "SINCELEJO", "TUNJA", "PASTO", "RIOHACHA", "QUIBDO",
        "FLORENCIA", "MOCOA", "LETICIA", "INIRIDA", "MITU", "PUERTO CARRENO",
        "SAN JOSE DEL GUAVIARE",
    ),
    "departamentos": (
        "CUNDINAMARCA", "ANTIOQUIA", "VALLE DEL CAUCA", "ATLANTICO", "BOLIVAR", "SANTANDER",
        "NORTE DE SANTANDER", "RISARALDA", "CALDAS", "QUINDIO", "TOLIMA", "HUILA", "NARINO",
        "BOYACA", "CESAR", "CORDOBA", "SUCRE", "META", "MAGDALENA", "CAUCA", "CASANARE", "ARAUCA",
        "PUTUMAYO", "CAQUETA", "LA GUAJIRA", "CHOCO", "VICHADA", "GUAINIA", "VAUPES", "AMAZONAS",
        "GUAVIARE", "ARCHIPIELAGO DE SAN ANDRES",
    ),
    "puertos": (
        "PUERTO DE CARTAGENA", "PUERTO DE BUENAVENTURA", "PUERTO DE BARRANQUILLA",
        "PUERTO DE SANTA MARTA", "PUERTO DE TUMACO", "TERMINAL MARITIMO DE CARTAGENA",
        "ZONA FRANCA DE BOGOTA", "ZONA FRANCA DE BARRANQUILLA", "ZONA FRANCA DE CUCUTA",
        "ZONA FRANCA PALMASECA", "ZONA FRANCA LA CANDELARIA", "ZONA FRANCA DEL PACIFICO",
        "ZONA FRANCA DE PEREIRA", "ZONA FRANCA DE BUENAVENTURA",
        "ZONA FRANCA PARQUE INDUSTRIAL DE BARRANQUILLA",
    ),
    "aduanas": (
        "ADUANA DE EL DORADO", "ADUANA DE BUENAVENTURA", "ADUANA DE CARTAGENA",
        "ADUANA DE BARRANQUILLA", "ADUANA DE MEDELLIN", "ADUANA DE SANTA MARTA",
        "ADUANA DE CUCUTA", "ADUANA DE IPIALES", "ADUANA DE PALMIRA", "ADUANA DE BOGOTA",
        "ADUANA DE RIOHACHA", "ADUANA DE TUMACO", "AEROPUERTO EL DORADO",
        "AEROPUERTO JOSE MARIA CORDOVA RIONEGRO", "AEROPUERTO ERNESTO CORTISSOZ BARRANQUILLA",
        "AEROPUERTO SIMON BOLIVAR SANTA MARTA", "AEROPUERTO RAFAEL NUNEZ CARTAGENA",
    ),
    "bancos": (
        "BANCOLOMBIA", "BANCO DE BOGOTA", "BANCO DAVIVIENDA", "BANCO BBVA COLOMBIA",
        "BANCO POPULAR", "BANCO AV VILLAS", "BANCO CAJA SOCIAL", "BANCO OCCIDENTE",
        "BANCO AGRARIO", "BANCO ITAU", "SCOTIABANK COLPATRIA", "BANCO FINANDINA", "BANCO W",
        "BANCAMIA", "COOFINEP", "BANCO GNB SUDAMERIS", "BANCO FALABELLA", "BANCO PICHINCHA",
        "BANCO SERFINANZA",
    ),
    "regimenes": (
        "IMPORTACION ORDINARIA", "EXPORTACION DEFINITIVA", "TRANSITO ADUANERO",
        "DEPOSITO ADUANERO", "ZONA FRANCA", "ADMISION TEMPORAL", "REIMPORTACION",
        "EXPORTACION TEMPORAL", "TRANSFORMACION Y ENSAMBLE", "DECLARACION DE IMPORTACION",
        "DECLARACION DE EXPORTACION", "LICENCIA DE IMPORTACION", "REGISTRO DE IMPORTACION",
    ),
}
# Which catalog a column name selects; the first rule whose word occurs in the name wins.
CATALOG_RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("ciudad", "municipio", "localidad"), "ciudades"),
    (("departamento",), "departamentos"),
    (("zona franca", "zona_franca", "zonafranca"), "puertos"),
    (("puerto", "terminal maritimo", "terminal portuario"), "puertos"),
    (("aduana", "aeropuerto"), "aduanas"),
    (("banco", "entidad financiera", "entidad bancaria"), "bancos"),
    (("regimen", "régimen", "modalidad", "tipo declaracion"), "regimenes"),
)

# --- fixed values: domain, intent and error vocabularies ---------------------------------------
COMPLIANCE_WORDS = (
    "dian", "fob", "cif", "arancel", "rips", "factura", "iva", "nandina", "partida", "subpartida",
    "regimen", "aduana", "declaracion", "importacion", "exportacion", "nit", "gravamen",
    "liquidacion", "tributo", "incoterm", "poliza", "endoso", "fletes", "seguro cif", "valor cif",
    "valor fob", "cuota", "impuesto", "retención", "retencion", "renta", "predial",
)
PREDICTION_WORDS = (
    "stock", "comprar", "buy", "cuánto", "cuanto", "how much", "pronóstico", "pronostico",
    "forecast", "recomendación", "recomendacion", "recommend", "inventory", "inventario",
    "pedido", "order", "esta semana", "this week", "semanas", "weeks", "predic",
)
CHART_WORDS = (
    "gráfic", "grafic", "chart", "tablero", "echart", "visualiz", "dashboard", "barras",
    "heatmap", "mapa de calor", "plot",
)
CODE_MARKS = (
    "read_csv", "read_excel", "pd.", "import pandas", "import pd", "generar_reporte_pdf",
    "generar_reporte_excel_avanzado",
)
# Error classes in the order they are tried.
ERROR_CLASSES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("unavailable", (
        "404", "not found", "no longer available", "is not supported", "does not exist",
    )),
    ("timeout", ("timeout", "timed out", "deadline exceeded", "504")),
    ("rate_limit", ("429", "rate", "quota", "resource exhausted")),
    ("auth", (
        "403", "leaked", "api key", "api_key", "invalid", "permission denied", "not authorized",
    )),
)

# --- fixed values: calendar --------------------------------------------------------------------
MONTHS_ES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre",
    "octubre", "noviembre", "diciembre",
)
MONTHS_EN = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
)

# --- fixed values: messages, chunks, tokens, quota ---------------------------------------------
MESSAGE_LIMIT = 4096 - 30
CAP_NOTE = "\n\n[— Respuesta recortada por límite del mensaje.]"
DIAGNOSTIC_LIMIT = 1800
DIAGNOSTIC_NOTE = "\n[Diagnóstico recortado]"
CHUNK_CHARS = 1500
CHUNK_OVERLAP = 200
EMBED_BATCH = 20
TOP_K = 5
MISSING_EVIDENCE = "Dato faltante para confirmar"
QUOTA_ZONE = "America/Bogota"
DAILY_LIMIT = 15
TOKEN_MINUTES = 30
DASHBOARD_TOKEN_MINUTES = 15
PREMIUM_PRICE = 40000
CHART_TYPES = ("bars", "heatmap", "pie", "treemap")
FREE_COLOUR = "#808080"
PREMIUM_COLOUR = "#28468C"

# --- fixed values: files -----------------------------------------------------------------------
TABLE_EXTENSIONS = ("csv", "xlsx", "xls")
DATA_EXTENSIONS = ("csv", "xlsx", "xls", "pdf", "docx", "txt")
UPLOAD_MAX_BYTES = 32 * 1024 * 1024
ALLOWED_MIME: dict[str, tuple[str, ...]] = {
    "pdf": ("application/pdf",),
    "csv": ("text/csv", "text/plain", "application/csv"),
    "txt": ("text/plain",),
    "xlsx": (
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip",
    ),
    "xls": ("application/vnd.ms-excel",),
    "doc": ("application/msword",),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
}
