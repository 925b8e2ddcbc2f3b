"""Fixed values shared by the operators."""

# Prediction horizons, rolling windows and thresholds.
HORIZONS = (3, 7, 15, 30)
ROLLING_WINDOWS = (3, 6, 12)
HIGH_RISK_FROM = 0.70
MEDIUM_RISK_FROM = 0.30
INTERVAL_HALF_WIDTH = 0.05
EPS = 1e-6

# Risk classes and the action each one asks for.
HIGH_RISK = "Alto Risco"
MEDIUM_RISK = "Médio Risco"
LOW_RISK = "Baixo Risco"
FAILED_SCORE = "Erro"
ACTION_BY_RISK = {
    HIGH_RISK: "Inspeção Imediata",
    MEDIUM_RISK: "Programar Inspeção",
    LOW_RISK: "Monitoramento Normal",
}

# Header names of the failure log after normalisation.
FAILURE_HEADERS = {
    "data_e_hora_de_inicio": "data",
    "descricao_do_evento": "descricao",
    "equipamentocomponente_envolvido": "ativo",
    "tipo_de_ocorrencia": "tipo_manutencao",
    "instalacao_localizacao": "instalacao",
    "instalacaolocalizacao": "instalacao",
    "moduloenvolvido": "modulo_envolvido",
}
FAILURE_REQUIRED = ("data", "ativo", "instalacao", "modulo_envolvido", "regional")

# Header names and 0-based positions of the work-order table.
WORK_ORDER_POSITIONS = {
    18: "local_de_servico",
    19: "instalacao",
    20: "sistema",
    29: "descricao_do_equipamento",
}
WORK_ORDER_HEADERS = {
    "tipo": "tipo_manutencao",
    "data_da_solicitacao": "data_de_abertura",
    "data_abertura": "data_de_abertura",
    "data_solicitacao": "data_de_abertura",
    "equipamento": "equipamento_original_j",
    "status": "status_da_ordem",
}
WORK_ORDER_DEFAULT_TYPE = "Preventiva"
WORK_ORDER_DEFAULT_TEXT = "Manutenção preventiva programada"

# Rows to skip and headers of the two task tables.
CAUSE_TASKS = {
    "skip": 8,
    "columns": {"% concluída": "progresso", "Atribuída a": "responsavel", "Nome": "tarefa"},
}
ACTION_PLANS = {
    "skip": 0,
    "columns": {
        "Status da Ação": "status",
        "Responsável pela Execução": "responsavel",
        "Término planejado": "prazo",
    },
}

# English column names used here -> names in the source documents.
SOURCE_NAMES = {
    "asset_id": "ativo_unico",
    "ts": "data",
    "region": "regional",
    "installation": "instalacao",
    "module": "modulo_envolvido",
    "equipment": "ativo",
    "maintenance_type": "tipo_manutencao",
    "description": "descricao",
    "event_id": "id_evento",
    "tbf": "tbf",
    "cumulative_failures": "falhas_acumuladas",
    "asset_age_days": "idade_ativo_dias",
    "month": "mes_falha",
    "weekday": "dia_semana_falha",
    "year": "ano_falha",
    "quarter": "trimestre_falha",
    "tbf_pct_change": "tbf_pct_change_1m",
    "tbf_volatility_3": "tbf_volatilidade_3m",
    "month_sin": "mes_sin",
    "month_cos": "mes_cos",
    "quarter_sin": "trimestre_sin",
    "quarter_cos": "trimestre_cos",
    "ratio_vs_mean_3": "ratio_vs_mean_3m",
    "ratio_vs_mean_6": "ratio_vs_mean_6m",
    "dist_from_min_6": "dist_from_min_6m",
    "dist_from_max_6": "dist_from_max_6m",
    "tbf_zscore_6": "tbf_zscore_6m",
    "survival_30d": "prob_sobrevivencia_30d",
}

# Metadata columns that are never features.
NOT_FEATURES = (
    "asset_id", "ts", "installation", "module", "equipment", "region",
    "description", "event_id", "maintenance_type",
    "ativo_unico", "data", "instalacao", "modulo_envolvido", "ativo",
    "regional", "descricao", "id_evento", "tipo_manutencao",
    "idevento", "idmacrom", "idticket", "os", "console", "area",
    "tipodeevento", "origemdoevento", "motivodoevento", "dimensaoafetada",
    "perdapotencial", "dataehoradefim", "analisedecausaraiz", "prioridade",
    "criteriosdeanalisedefalha", "causasidentificadas", "possiveissolucoes",
    "statusdeanalise", "houveindisponibilidadedotramodispsis", "redundancia",
    "obssobredisp", "id", "tef", "base", "grupo", "associadoaocao",
    "sobreaviso", "responsavel", "estudoesom", "codigodaposicao", "tipodevalvula",
)

# Severity, trend, impact and confidence words of the cause report.
SEVERITY = ("CRÍTICA", "ALTA", "MODERADA", "BAIXA")
RISING, FALLING, STEADY = "crescente", "decrescente", "estável"
INCREASE, DECREASE = "Aumento", "Queda"
CONF_HIGH, CONF_MEDIUM, CONF_LOW = "ALTA", "MÉDIA", "BAIXA"

# Ordered keyword -> action rules (first match wins). The English
# feature names of this library follow the keyword they stand for.
ACTION_RULES = (
    ("tbf", "Reduzir intervalo de manutenção preventiva - TBF está decaindo"),
    ("tbf_mean", "Intensificar monitoramento - Média de TBF abaixo do esperado"),
    ("tbf_volatilidade", "Investigar variações operacionais - Alta volatilidade detectada"),
    ("tbf_volatility", "Investigar variações operacionais - Alta volatilidade detectada"),
    ("falhas_acumuladas", "Ativo crítico - Considerar substituição ou overhaul"),
    ("cumulative_failures", "Ativo crítico - Considerar substituição ou overhaul"),
    ("idade_ativo", "Ativo envelhecido - Planejar substituição ou recondicionamento"),
    ("asset_age", "Ativo envelhecido - Planejar substituição ou recondicionamento"),
    ("temperatura", "Verificar sistema de resfriamento e lubrificação"),
    ("pressao", "Inspecionar vedações e sistema de pressurização"),
    ("vibracao", "Verificar alinhamento, balanceamento e fixação"),
    ("corrosao", "Inspecionar materiais e proteção anticorrosiva"),
)

# Fields of the JSON documents of the prediction history, and their names here.
HISTORY_FIELDS = {
    "ativo_unico": "asset_id",
    "data_predicao": "predicted_at",
    "horizonte": "horizon",
    "probabilidade": "probability",
    "classe_predita": "risk",
    "modelo_versao": "model_version",
    "resultado_real": "outcome",
    "data_resultado": "occurred_at",
}
