"""Schemas of the raw (Bronze) files, the Gold table and the lookups, plus the
fixed label tables used to present codes."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw positional layouts (no header; every column is text).
# Column order of the published registry files.
# ---------------------------------------------------------------------------
COMPANIES_RAW_COLUMNS = [
    "cnpj_basico",
    "razao_social",
    "natureza_juridica",
    "qualificacao_responsavel",
    "capital_social",
    "porte_empresa",
    "ente_federativo_responsavel",
]

ESTABLISHMENTS_RAW_COLUMNS = [
    "cnpj_basico",
    "cnpj_ordem",
    "cnpj_dv",
    "matriz_filial",
    "nome_fantasia",
    "situacao_cadastral",
    "data_situacao",
    "motivo_situacao",
    "nome_cidade_exterior",
    "pais",
    "data_inicio_atividade",
    "cnae_fiscal",
    "cnae_secundaria",
    "tipo_logradouro",
    "logradouro",
    "numero",
    "complemento",
    "bairro",
    "cep",
    "uf",
    "municipio",
    "ddd_1",
    "telefone_1",
    "ddd_2",
    "telefone_2",
    "ddd_fax",
    "fax",
    "correio_eletronico",
    "situacao_especial",
    "data_situacao_especial",
]

REFERENCE_RAW_COLUMNS = ["codigo", "descricao"]


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


COMPANIES_RAW = text_schema(COMPANIES_RAW_COLUMNS)
ESTABLISHMENTS_RAW = text_schema(ESTABLISHMENTS_RAW_COLUMNS)
REFERENCE_RAW = text_schema(REFERENCE_RAW_COLUMNS)

MONEY = T.DecimalType(20, 2)

GOLD = T.StructType(
    [
        T.StructField("company_id", T.StringType(), False),
        T.StructField("legal_name", T.StringType(), True),
        T.StructField("legal_nature_code", T.LongType(), True),
        T.StructField("share_capital", MONEY, False),
        T.StructField("opened_on", T.DateType(), False),
        T.StructField("activity_code", T.LongType(), True),
        T.StructField("city_code", T.LongType(), True),
        T.StructField("state", T.StringType(), True),
        T.StructField("status_code", T.IntegerType(), True),
        T.StructField("status_on", T.DateType(), True),
    ]
)

GOLD_COLUMNS = [f.name for f in GOLD.fields]

REFERENCE = T.StructType(
    [
        T.StructField("code", T.LongType(), True),
        T.StructField("description", T.StringType(), True),
    ]
)

# ---------------------------------------------------------------------------
# Registry status codes and their labels.
# ---------------------------------------------------------------------------
STATUS_LABELS = {1: "Nula", 2: "Ativa", 3: "Suspensa", 4: "Inapta", 8: "Baixada"}
STATUS_ACTIVE = 2
STATUS_CLOSED = 8

# ---------------------------------------------------------------------------
# Two-digit municipality-code prefix -> state abbreviation.
# ---------------------------------------------------------------------------
STATE_PREFIX_LABELS = {
    "11": "RO", "12": "AC", "13": "AM", "14": "RR", "15": "PA",
    "16": "AP", "17": "TO", "21": "MA", "22": "PI", "23": "CE",
    "24": "RN", "25": "PB", "26": "PE", "27": "AL", "28": "SE",
    "29": "BA", "31": "MG", "32": "ES", "33": "RJ", "35": "SP",
    "41": "PR", "42": "SC", "43": "RS", "50": "MS", "51": "MT",
    "52": "GO", "53": "DF",
}

# ---------------------------------------------------------------------------
# Activity division (first two digits) -> short sector label.
# ---------------------------------------------------------------------------
DIVISION_LABELS = {
    "01": "Agricultura", "10": "Alimentos", "13": "Têxtil",
    "20": "Química", "23": "Minerais não-metálicos", "25": "Metal",
    "26": "Eletrônicos", "28": "Máquinas", "33": "Manutenção",
    "35": "Eletricidade", "41": "Construção Civil", "45": "Automotivo",
    "46": "Comércio Atacadista", "47": "Comércio Varejista",
    "49": "Transporte Terrestre", "52": "Armazenagem", "55": "Hospedagem",
    "56": "Alimentação", "58": "Publicações", "61": "Telecom",
    "62": "TI/Software", "63": "Dados/TI", "64": "Finanças",
    "65": "Seguros", "68": "Imobiliário", "69": "Jurídico",
    "70": "Gestão", "71": "Engenharia", "72": "P&D",
    "73": "Publicidade", "74": "Design/Foto", "75": "Veterinária",
    "77": "Locação", "78": "RH/Recrutamento", "79": "Turismo",
    "80": "Vigilância", "81": "Facilities", "82": "Administração",
    "84": "Administração Pública", "85": "Educação", "86": "Saúde",
    "87": "Assistência Social", "90": "Arte/Cultura", "93": "Esporte",
    "94": "Associações", "96": "Serviços Pessoais",
}

# ---------------------------------------------------------------------------
# Share-capital bands (right-closed upper bounds) and labels.
# ---------------------------------------------------------------------------
CAPITAL_BAND_EDGES = [0, 10_000, 100_000, 1_000_000]
CAPITAL_BAND_LABELS = ["Até 10k", "10k - 100k", "100k - 1M", "Acima de 1M"]

# ---------------------------------------------------------------------------
# Severity badge thresholds (percent) and labels.
# ---------------------------------------------------------------------------
BADGE_OK_BELOW = 1
BADGE_WARN_BELOW = 5
BADGE_LABELS = ("OK", "Atenção", "Crítico")

# Wildcard words of a saved filter ("any sector", "any city").
ANY_SECTOR = "Todos"
ANY_CITY = "Todas"
