"""Word lists and lookup tables that results depend on."""

# Status texts that mean a bill has come to its end.
FINISHED_TERMS = [
    "arquivada",
    "transformada em norma jurídica",
    "rejeitada",
    "retirada",
    "declarada prejudicada",
    "encerrada",
    "vetado totalmente",
    "devolvida ao(à) Autor(a)",
    "retirado pelo(a) Autor(a)",
    "transformado em nova proposição",
    "aguardando sanção",
]

# Status texts that mean a bill was approved.
APPROVED_TERMS = [
    "transformada em norma",
    "transformado em norma jurídica",
    "transformado em lei",
    "promulgado",
    "sanção",
    "aguardando sanção",
]

# Keyword to category; the first keyword found decides.
KEYWORD_RULES = [
    ("saúde", "Saúde"),
    ("vacinação", "Saúde"),
    ("educação", "Educação"),
    ("ensino", "Educação"),
    ("meio ambiente", "Meio Ambiente"),
    ("ambiental", "Meio Ambiente"),
    ("imposto", "Economia"),
    ("tributação", "Economia"),
    ("financiamento", "Economia"),
    ("trabalho", "Direitos Humanos"),
    ("mulher", "Direitos Humanos"),
    ("violência", "Segurança Pública"),
    ("segurança", "Segurança Pública"),
    ("crime", "Segurança Pública"),
]

# State to region.
REGION_OF_STATE = {
    "AC": "Norte", "AP": "Norte", "AM": "Norte", "PA": "Norte", "RO": "Norte", "RR": "Norte", "TO": "Norte",
    "AL": "Nordeste", "BA": "Nordeste", "CE": "Nordeste", "MA": "Nordeste", "PB": "Nordeste",
    "PE": "Nordeste", "PI": "Nordeste", "RN": "Nordeste", "SE": "Nordeste",
    "DF": "Centro-Oeste", "GO": "Centro-Oeste", "MT": "Centro-Oeste", "MS": "Centro-Oeste",
    "ES": "Sudeste", "MG": "Sudeste", "RJ": "Sudeste", "SP": "Sudeste",
    "PR": "Sul", "RS": "Sul", "SC": "Sul",
}

# Party to bloc.
BLOC_OF_PARTY = {
    "PT": "Esquerda", "PSOL": "Esquerda", "PCdoB": "Esquerda", "REDE": "Esquerda",
    "PSB": "Esquerda", "PDT": "Esquerda", "PV": "Esquerda",
    "MDB": "Centrão", "PSD": "Centrão", "PP": "Centrão", "PL": "Centrão",
    "REPUBLICANOS": "Direita", "UNIÃO": "Centrão", "AVANTE": "Centrão", "CIDADANIA": "Centrão",
    "PODE": "Centrão", "SOLIDARIEDADE": "Centrão", "PATRIOTA": "Centrão", "PROS": "Centrão", "PRD": "Centrão",
    "NOVO": "Direita", "PSC": "Direita", "DEM": "Direita", "PSL": "Direita",
    "PRTB": "Direita", "PTB": "Direita", "PSDB": "Direita",
}

# State name to state code.
STATE_CODES = {
    "Acre": "AC", "Alagoas": "AL", "Amapá": "AP", "Amazonas": "AM", "Bahia": "BA", "Ceará": "CE",
    "Distrito Federal": "DF", "Espírito Santo": "ES", "Goiás": "GO", "Maranhão": "MA",
    "Mato Grosso": "MT", "Mato Grosso do Sul": "MS", "Minas Gerais": "MG", "Pará": "PA",
    "Paraíba": "PB", "Paraná": "PR", "Pernambuco": "PE", "Piauí": "PI", "Rio de Janeiro": "RJ",
    "Rio Grande do Norte": "RN", "Rio Grande do Sul": "RS", "Rondônia": "RO", "Roraima": "RR",
    "Santa Catarina": "SC", "São Paulo": "SP", "Sergipe": "SE", "Tocantins": "TO",
}

# Whole theme text to category, used when no keyword is found.
CATEGORY_OF_THEME = {
    "Agricultura, Pecuária, Pesca e Extrativismo": "Economia",
    "Estrutura Fundiária": "Direitos Humanos",
    "Administração Pública": "Economia",
    "Viação, Transporte e Mobilidade": "Meio Ambiente",
    "Agricultura, Pecuária, Pesca e Extrativismo, Viação, Transporte e Mobilidade": "Meio Ambiente",
    "Cidades e Desenvolvimento Urbano, Viação, Transporte e Mobilidade": "Meio Ambiente",
    "Arte, Cultura e Religião, Comunicações": "Educação",
    "Arte, Cultura e Religião": "Educação",
    "Administração Pública, Cidades e Desenvolvimento Urbano": "Meio Ambiente",
    "Agricultura, Pecuária, Pesca e Extrativismo, Cidades e Desenvolvimento Urbano": "Meio Ambiente",
    "Administração Pública, Cidades e Desenvolvimento Urbano, Estrutura Fundiária": "Economia",
    "Administração Pública, Viação, Transporte e Mobilidade": "Meio Ambiente",
    "Administração Pública, Cidades e Desenvolvimento Urbano, Direitos Humanos e Minorias": "Direitos Humanos",
    "Administração Pública, Arte, Cultura e Religião, Finanças Públicas e Orçamento": "Economia",
    "Direitos Humanos e Minorias, Economia, Finanças Públicas e Orçamento": "Economia",
    "Direitos Humanos e Minorias, Finanças Públicas e Orçamento": "Economia",
    "Economia, Previdência e Assistência Social": "Saúde",
    "Direitos Humanos e Minorias, Viação, Transporte e Mobilidade": "Direitos Humanos",
    "Direito Civil e Processual Civil, Direitos Humanos e Minorias": "Direitos Humanos",
    "Energia, Recursos Hídricos e Minerais, Finanças Públicas e Orçamento": "Meio Ambiente",
    "Direito Civil e Processual Civil, Viação, Transporte e Mobilidade": "Segurança Pública",
    "Cidades e Desenvolvimento Urbano, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Direitos Humanos e Minorias, Economia, Previdência e Assistência Social": "Saúde",
    "Administração Pública, Direitos Humanos e Minorias, Previdência e Assistência Social": "Saúde",
    "Agricultura, Pecuária, Pesca e Extrativismo, Energia, Recursos Hídricos e Minerais, Finanças Públicas e Orçamento": "Meio Ambiente",
    "Direito Civil e Processual Civil, Direitos Humanos e Minorias, Viação, Transporte e Mobilidade": "Direitos Humanos",
    "Agricultura, Pecuária, Pesca e Extrativismo, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Agricultura, Pecuária, Pesca e Extrativismo, Finanças Públicas e Orçamento, Indústria, Comércio e Serviços": "Economia",
    "Cidades e Desenvolvimento Urbano, Direitos Humanos e Minorias": "Direitos Humanos",
    "Direitos Humanos e Minorias, Previdência e Assistência Social": "Saúde",
    "Direito Civil e Processual Civil, Direito Penal e Processual Penal, Direitos Humanos e Minorias": "Direitos Humanos",
    "Energia, Recursos Hídricos e Minerais, Finanças Públicas e Orçamento, Política, Partidos e Eleições": "Meio Ambiente",
    "Finanças Públicas e Orçamento, Viação, Transporte e Mobilidade": "Economia",
    "Administração Pública, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Economia, Finanças Públicas e Orçamento": "Economia",
    "Direito e Defesa do Consumidor, Viação, Transporte e Mobilidade": "Direitos Humanos",
    "Administração Pública, Cidades e Desenvolvimento Urbano, Finanças Públicas e Orçamento": "Economia",
    "Energia, Recursos Hídricos e Minerais, Viação, Transporte e Mobilidade": "Meio Ambiente",
    "Administração Pública, Direito Penal e Processual Penal": "Segurança Pública",
    "Administração Pública, Cidades e Desenvolvimento Urbano, Direito e Defesa do Consumidor, Viação, Transporte e Mobilidade": "Direitos Humanos",
    "Administração Pública, Direitos Humanos e Minorias, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Direito Penal e Processual Penal, Indústria, Comércio e Serviços": "Economia",
    "Arte, Cultura e Religião, Direitos Humanos e Minorias, Esporte e Lazer": "Direitos Humanos",
    "Direito e Justiça, Direito Penal e Processual Penal": "Segurança Pública",
    "Arte, Cultura e Religião, Finanças Públicas e Orçamento": "Economia",
    "Economia, Viação, Transporte e Mobilidade": "Economia",
    "Direito Penal e Processual Penal, Estrutura Fundiária": "Segurança Pública",
    "Ciência, Tecnologia e Inovação, Finanças Públicas e Orçamento": "Economia",
    "Direitos Humanos e Minorias, Energia, Recursos Hídricos e Minerais, Finanças Públicas e Orçamento": "Meio Ambiente",
    "Direito e Defesa do Consumidor": "Direitos Humanos",
    "Direito e Defesa do Consumidor, Direito Penal e Processual Penal": "Direitos Humanos",
    "Direito Civil e Processual Civil, Direitos Humanos e Minorias, Estrutura Fundiária": "Direitos Humanos",
    "Previdência e Assistência Social": "Saúde",
    "Direitos Humanos e Minorias, Esporte e Lazer, Indústria, Comércio e Serviços": "Economia",
    "Direito Civil e Processual Civil, Finanças Públicas e Orçamento": "Economia",
    "Ciência, Tecnologia e Inovação, Direito Penal e Processual Penal, Direitos Humanos e Minorias": "Direitos Humanos",
    "Comunicações, Direito e Justiça, Direito Penal e Processual Penal": "Segurança Pública",
    "Administração Pública, Direito Civil e Processual Civil, Estrutura Fundiária": "Segurança Pública",
    "Direitos Humanos e Minorias, Estrutura Fundiária": "Direitos Humanos",
    "Direito e Defesa do Consumidor, Direitos Humanos e Minorias, Economia": "Economia",
    "Direito e Defesa do Consumidor, Direitos Humanos e Minorias": "Direitos Humanos",
    "Administração Pública, Direito Penal e Processual Penal, Finanças Públicas e Orçamento": "Economia",
    "Direito Penal e Processual Penal, Viação, Transporte e Mobilidade": "Segurança Pública",
    "Economia, Finanças Públicas e Orçamento, Indústria, Comércio e Serviços": "Economia",
    "Direitos Humanos e Minorias, Indústria, Comércio e Serviços": "Economia",
    "Administração Pública, Direitos Humanos e Minorias": "Direitos Humanos",
    "Direito e Defesa do Consumidor, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Finanças Públicas e Orçamento, Indústria, Comércio e Serviços, Relações Internacionais e Comércio Exterior": "Economia",
    "Administração Pública, Direito Penal e Processual Penal, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Comunicações, Direito Penal e Processual Penal, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Administração Pública, Direitos Humanos e Minorias, Economia, Finanças Públicas e Orçamento": "Economia",
    "Administração Pública, Direito e Defesa do Consumidor, Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Cidades e Desenvolvimento Urbano, Energia, Recursos Hídricos e Minerais, Indústria, Comércio e Serviços": "Meio Ambiente",
    "Comunicações, Direito Penal e Processual Penal": "Segurança Pública",
    "Ciência, Tecnologia e Inovação, Indústria, Comércio e Serviços": "Economia",
    "Indústria, Comércio e Serviços, Viação, Transporte e Mobilidade": "Economia",
    "Direito Penal e Processual Penal, Energia, Recursos Hídricos e Minerais, Indústria, Comércio e Serviços": "Meio Ambiente",
    "Homenagens e Datas Comemorativas": "Homenagens",
    "Direito Penal e Processual Penal, Direitos Humanos e Minorias": "Segurança Pública",
    "Direito Penal e Processual Penal": "Segurança Pública",
    "Direito Penal e Processual Penal, Homenagens e Datas Comemorativas": "Segurança Pública",
    "Direito Penal e Processual Penal, Direitos Humanos e Minorias, Indústria, Comércio e Serviços": "Segurança Pública",
    "Direito Civil e Processual Civil": "Segurança Pública",
    "Direito Civil e Processual Civil, Economia": "Segurança Pública",
    "Administração Pública, Direito Civil e Processual Civil": "Segurança Pública",
    "Administração Pública, Direito e Justiça": "Segurança Pública",
    "Direitos Humanos e Minorias": "Direitos Humanos",
    "Direitos Humanos e Minorias, Homenagens e Datas Comemorativas": "Direitos Humanos",
    "Direitos Humanos e Minorias, Esporte e Lazer": "Direitos Humanos",
    "Direitos Humanos e Minorias, Finanças Públicas e Orçamento, Previdência e Assistência Social": "Saúde",
    "Direitos Humanos e Minorias, Economia, Finanças Públicas e Orçamento, Previdência e Assistência Social": "Saúde",
    "Administração Pública, Finanças Públicas e Orçamento, Previdência e Assistência Social": "Saúde",
    "Energia, Recursos Hídricos e Minerais": "Meio Ambiente",
    "Economia": "Economia",
    "Finanças Públicas e Orçamento": "Economia",
    "Esporte e Lazer, Finanças Públicas e Orçamento": "Economia",
    "Turismo": "Economia",
    "Comunicações": "Economia",
    "Direito e Defesa do Consumidor, Energia, Recursos Hídricos e Minerais, Finanças Públicas e Orçamento": "Economia",
    "Economia, Finanças Públicas e Orçamento, Relações Internacionais e Comércio Exterior": "Economia",
    "Economia, Finanças Públicas e Orçamento, Indústria, Comércio e Serviços, Relações Internacionais e Comércio Exterior": "Economia",
    "Economia, Indústria, Comércio e Serviços": "Economia",
    "Finanças Públicas e Orçamento, Indústria, Comércio e Serviços": "Economia",
    "Administração Pública, Economia, Finanças Públicas e Orçamento": "Economia",
    "Administração Pública, Finanças Públicas e Orçamento": "Economia",
    "Administração Pública, Ciência, Tecnologia e Inovação": "Economia",
    "Administração Pública, Ciência, Tecnologia e Inovação, Viação, Transporte e Mobilidade": "Economia",
    "Administração Pública, Comunicações": "Economia",
    "Administração Pública, Indústria, Comércio e Serviços, Turismo": "Economia",
    "Administração Pública, Relações Internacionais e Comércio Exterior": "Economia",
    "Arte, Cultura e Religião, Economia, Homenagens e Datas Comemorativas, Turismo": "Economia",
    "Agricultura, Pecuária, Pesca e Extrativismo, Finanças Públicas e Orçamento": "Economia",
    "Homenagens e Datas Comemorativas, Viação, Transporte e Mobilidade": "Homenagens",
    "Esporte e Lazer, Homenagens e Datas Comemorativas": "Homenagens",
    "Arte, Cultura e Religião, Homenagens e Datas Comemorativas": "Homenagens",
    "Administração Pública, Homenagens e Datas Comemorativas": "Homenagens",
    "Comunicações, Homenagens e Datas Comemorativas": "Homenagens",
}
