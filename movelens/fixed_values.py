"""Word lists, weights and constants that results depend on.

Everything here is data, kept as plain text in its natural order. Other data
sets pass their own tables to the operators instead.
"""

from __future__ import annotations

# --- Fixed values: score weights per position; each row sums to 1. ----------
COMPONENTS = (
    "perf_level", "perf_delta", "value_growth", "playing_time", "value_for_money",
    "rating", "attacking", "defensive", "possession", "resale_profit",
)
POSITION_WEIGHTS = {
    "Attack": (0.16, 0.08, 0.10, 0.10, 0.10, 0.20, 0.11, 0.02, 0.05, 0.08),
    "Midfield": (0.12, 0.06, 0.10, 0.10, 0.10, 0.20, 0.10, 0.05, 0.09, 0.08),
    "Defender": (0.04, 0.02, 0.10, 0.11, 0.10, 0.30, 0.04, 0.13, 0.08, 0.08),
    "Goalkeeper": (0.00, 0.00, 0.10, 0.17, 0.10, 0.20, 0.00, 0.28, 0.07, 0.08),
}
SUB_POSITION_WEIGHTS = {
    "Left Winger": (0.13, 0.06, 0.10, 0.09, 0.10, 0.20, 0.09, 0.02, 0.13, 0.08),
    "Right Winger": (0.13, 0.06, 0.10, 0.09, 0.10, 0.20, 0.09, 0.02, 0.13, 0.08),
    "Defensive Midfield": (0.03, 0.02, 0.10, 0.09, 0.10, 0.30, 0.01, 0.13, 0.14, 0.08),
    "Attacking Midfield": (0.12, 0.06, 0.10, 0.10, 0.10, 0.20, 0.09, 0.02, 0.13, 0.08),
    "Left Midfield": (0.10, 0.05, 0.10, 0.10, 0.10, 0.20, 0.08, 0.03, 0.16, 0.08),
    "Right Midfield": (0.10, 0.05, 0.10, 0.10, 0.10, 0.20, 0.08, 0.03, 0.16, 0.08),
    "Centre-Back": (0.01, 0.01, 0.10, 0.08, 0.10, 0.30, 0.01, 0.19, 0.12, 0.08),
    "Right-Back": (0.01, 0.01, 0.10, 0.09, 0.10, 0.30, 0.03, 0.16, 0.12, 0.08),
    "Left-Back": (0.01, 0.01, 0.10, 0.09, 0.10, 0.30, 0.03, 0.16, 0.12, 0.08),
}
LOAN_COMPONENTS = (
    "perf_level", "perf_delta", "value_growth", "playing_time",
    "rating", "attacking", "defensive", "possession",
)
LOAN_POSITION_WEIGHTS = {
    "Attack": (0.23, 0.10, 0.12, 0.27, 0.20, 0.05, 0.01, 0.02),
    "Midfield": (0.19, 0.08, 0.12, 0.27, 0.20, 0.06, 0.03, 0.05),
    "Defender": (0.09, 0.04, 0.12, 0.31, 0.30, 0.03, 0.05, 0.06),
    "Goalkeeper": (0.00, 0.00, 0.12, 0.44, 0.20, 0.00, 0.22, 0.02),
}
LOAN_SUB_POSITION_WEIGHTS = {
    "Left Winger": (0.19, 0.08, 0.12, 0.27, 0.20, 0.05, 0.01, 0.08),
    "Right Winger": (0.19, 0.08, 0.12, 0.27, 0.20, 0.05, 0.01, 0.08),
    "Defensive Midfield": (0.10, 0.04, 0.12, 0.25, 0.30, 0.02, 0.07, 0.10),
    "Attacking Midfield": (0.20, 0.09, 0.12, 0.25, 0.20, 0.05, 0.01, 0.08),
    "Left Midfield": (0.18, 0.08, 0.12, 0.25, 0.20, 0.05, 0.02, 0.10),
    "Right Midfield": (0.18, 0.08, 0.12, 0.25, 0.20, 0.05, 0.02, 0.10),
    "Centre-Back": (0.03, 0.02, 0.12, 0.28, 0.30, 0.01, 0.14, 0.10),
    "Right-Back": (0.04, 0.02, 0.12, 0.29, 0.30, 0.02, 0.12, 0.09),
    "Left-Back": (0.04, 0.02, 0.12, 0.29, 0.30, 0.02, 0.12, 0.09),
}
# Decay curves as (min, max, decay years).
RESALE_CURVE = (0.02, 0.20, 2.0)
VALUE_CURVE = (0.02, 0.15, 3.0)

# --- Fixed values: provider statistics. -------------------------------------
PROVIDER_STATS = (
    "rating", "mins_played", "goals_per_90", "expected_goals_per_90", "expected_assists_per_90",
    "accurate_pass", "total_att_assist", "big_chance_created", "won_contest", "total_tackle",
    "interception", "effective_clearance", "defensive_contributions", "ball_recovery", "clean_sheet",
    "saves", "_save_percentage", "goals_conceded", "fouls",
)
# Season totals are added up across seasons; every other stat is a rate.
PROVIDER_COUNTS = ("mins_played", "total_att_assist", "big_chance_created", "clean_sheet")
PROVIDER_PREFIX = "fotmob_"
PROVIDER_COLUMNS = (
    "fotmob_rating", "fotmob_total_minutes", "fotmob_seasons_used", "fotmob_total_matches",
    "fotmob_goals_per_90", "fotmob_expected_goals_per_90", "fotmob_expected_assists_per_90",
    "fotmob_won_contest", "fotmob_big_chance_created", "fotmob_total_att_assist",
    "fotmob_total_tackle", "fotmob_interception", "fotmob_effective_clearance", "fotmob_ball_recovery",
    "fotmob_accurate_pass", "fotmob_saves", "fotmob__save_percentage", "fotmob_goals_conceded",
)
PRE_PROVIDER_COLUMNS = (
    "pre_fotmob_rating", "pre_fotmob_total_minutes", "pre_fotmob_seasons_used", "pre_fotmob_total_matches",
    "pre_fotmob_goals_per_90", "pre_fotmob_expected_goals_per_90", "pre_fotmob_expected_assists_per_90",
    "pre_fotmob_won_contest", "pre_fotmob_total_att_assist",
    "pre_fotmob_total_tackle", "pre_fotmob_interception", "pre_fotmob_effective_clearance", "pre_fotmob_ball_recovery",
    "pre_fotmob_accurate_pass", "pre_fotmob_saves", "pre_fotmob__save_percentage", "pre_fotmob_goals_conceded",
)
ATTACKING_STATS = (
    "fotmob_goals_per_90", "fotmob_expected_goals_per_90", "fotmob_expected_assists_per_90",
    "fotmob_chances_created_p90", "fotmob_big_chance_created_p90",
)
DEFENSIVE_STATS = (
    "fotmob_total_tackle", "fotmob_interception", "fotmob_effective_clearance", "fotmob_ball_recovery",
)
KEEPER_STATS = ("fotmob_saves", "fotmob__save_percentage", "fotmob_goals_conceded_inv")
POSSESSION_STATS = ("fotmob_accurate_pass", "fotmob_won_contest")
KEEPER = "Goalkeeper"

# --- Fixed values: model features. ------------------------------------------
PRE_STATS = (
    "pre_fotmob_rating",
    "pre_fotmob_expected_goals_per_90", "pre_fotmob_expected_assists_per_90", "pre_fotmob_chances_created_p90",
    "pre_fotmob_accurate_pass", "pre_fotmob_won_contest",
    "pre_fotmob_total_tackle", "pre_fotmob_interception", "pre_fotmob_effective_clearance", "pre_fotmob_ball_recovery",
    "pre_fotmob_saves", "pre_fotmob__save_percentage", "pre_fotmob_goals_conceded",
)
PRE_INVERTED = ("pre_fotmob_goals_conceded",)
PRE_BUCKETS = {
    "rating": ("pre_fotmob_rating",),
    "attacking": (
        "pre_fotmob_expected_goals_per_90", "pre_fotmob_expected_assists_per_90", "pre_fotmob_chances_created_p90",
    ),
    "defensive": (
        "pre_fotmob_total_tackle", "pre_fotmob_interception", "pre_fotmob_effective_clearance", "pre_fotmob_ball_recovery",
    ),
    "possession": ("pre_fotmob_accurate_pass", "pre_fotmob_won_contest"),
}
PRE_KEEPER_BUCKET = ("pre_fotmob_saves", "pre_fotmob__save_percentage", "pre_fotmob_goals_conceded")
COMPOSITES = tuple(f"pre_fotmob_{b}_pct" for b in PRE_BUCKETS)
COMPOSITE_FLAGS = tuple(f"has_pre_{b}_data" for b in PRE_BUCKETS)
NUMERIC_FEATURES = (
    "age_at_transfer", "height_vs_position",
    "pre_apps", "pre_minutes", "pre_goals_p90", "pre_ga_p90", "pre_mins_per_app",
    "log_transfer_fee", "log_value_before", "fee_to_value_ratio", "club_quality_ratio",
    "log_from_club_value", "log_to_club_value",
    *COMPOSITES, *COMPOSITE_FLAGS,
)
CATEGORICAL_FEATURES = (
    "position", "sub_position", "foot", "from_domestic_competition_id", "to_domestic_competition_id",
)
POSITION_CONDITIONAL = (
    "age_at_transfer", "pre_apps", "pre_minutes",
    "pre_goals_p90", "pre_ga_p90", "pre_mins_per_app",
    "log_value_before", "log_from_club_value", "log_to_club_value", "club_quality_ratio",
)
RECENT_FEATURES = ("pre_apps", "pre_minutes", "pre_goals_p90", "pre_ga_p90", "pre_mins_per_app")
PLAYING_TIME_FEATURES = ("pre_apps", "pre_minutes", "pre_mins_per_app")
SENSITIVITY_FEATURES = ("pre_goals_p90", "pre_ga_p90", *COMPOSITES)
SPLIT_DATE = "2023-06-01"
HALF_LIFE_YEARS = 3.0
RIDGE_ALPHA = 1.0
MIN_CATEGORY_ROWS = 30
MIN_PERCENTILE_ROWS = 20
FOLDS = 5
NEIGHBOURS = 5

# --- Fixed values: covered leagues. -----------------------------------------
COVERED_LEAGUES = (
    "GB1", "IT1", "TR1", "L1", "FR1", "ES1", "RU1", "NL1", "GR1", "UKR1", "BE1", "PO1", "DK1", "SC1", "A1", "SER1", "SE1", "C1", "NO1",
    "TS1", "PL1", "RO1", "KR1",
)
# Leagues whose season is one calendar year.
SINGLE_YEAR_LEAGUES = ("NO1", "SE1")
SUMMER_MONTHS = (6, 7, 8)

# --- Fixed values: club name matching across sources. -----------------------
CLUB_FILLER_WORDS = (
    "fc", "cf", "ac", "afc", "sc", "sv", "ca", "cd", "sd", "ud", "rcd", "vfb", "vfl",
    "tsg", "ssc", "aj", "og", "ogc", "sm", "fk", "sk", "pfc", "bc", "calcio", "club",
    "1", "04", "05", "1925", "de", "la", "le", "der",
)
CLUB_WORD_SYNONYMS = {"moskva": "moscow", "moskau": "moscow"}
LEAGUE_CLUB_ALIASES = {
    "GB1": {
        "brighton": "brighton and hove albion", "huddersfield": "huddersfield town",
        "ipswich": "ipswich town", "leeds": "leeds united", "leicester": "leicester city",
        "luton": "luton town", "man city": "manchester city", "man utd": "manchester united",
        "newcastle": "newcastle united", "norwich": "norwich city",
        "nott m forest": "nottingham forest", "nottm forest": "nottingham forest",
        "sheff utd": "sheffield united", "swansea": "swansea city", "tottenham": "tottenham hotspur",
        "west brom": "west bromwich albion", "west ham": "west ham united",
        "wolves": "wolverhampton wanderers",
    },
    "FR1": {"psg": "paris saint germain", "stade rennais": "rennes"},
    "DK1": {"copenhagen": "fc kobenhavn", "fc copenhagen": "fc kobenhavn"},
}
# Letters without a canonical decomposition, and what they are written as.
NORDIC_SLAVIC = {
    "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "å": "a", "Å": "A",
    "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "ß": "ss",
}
CLUB_SIMILARITY = 0.72
NAME_SIMILARITY = 0.6
CLOSE_NAMES = 3

# --- Fixed values: one spelling per club. ------------------------------------
CLUB_STRIP_TOKENS = (
    "fc", "cf", "cfc", "acf", "ssc", "uc", "bc", "as", "gd", "cd", "ud", "kv", "krc", "rc", "fk",
    "sc", "ac", "afc", "club", "de", "football", "calcio",
    "vfl", "vfb", "tsv", "sv", "ssv", "us",
    "spor", "kulubu", "jimnastik",
)
CLUB_FORCE_SPLIT = ("Racing",)
CLUB_NICKNAMES = (
    ("Man City", "Manchester City"),
    ("Man Utd", "Manchester United"),
    ("PSG", "Paris SG", "Paris Saint-Germain"),
    ("Bor. Dortmund", "Borussia Dortmund", "Dortmund"),
    ("Tottenham", "Tottenham Hotspur"),
    ("Newcastle", "Newcastle United"),
    ("West Ham", "West Ham United"),
    ("West Brom", "West Bromwich Albion"),
    ("Brighton", "Brighton & Hove Albion"),
    ("Leeds", "Leeds United"),
    ("Leicester", "Leicester City"),
    ("AS Monaco", "Monaco"),
    ("Lyon", "Olympique Lyon"),
    ("Marseille", "Olympique Marseille"),
    ("LOSC Lille", "Lille"),
    ("Nice", "OGC Nice"),
    ("Real Betis", "Real Betis Balompié"),
    ("Athletic Bilbao", "Athletic Club", "Athletic"),
    ("Ajax", "Ajax Amsterdam"),
    ("Feyenoord", "Feyenoord Rotterdam"),
    ("PSV", "PSV Eindhoven"),
    ("Benfica", "SL Benfica"),
    ("Espanyol", "RCD Espanyol Barcelona"),
    ("Hamburg", "Hamburger SV"),
    ("Zenit S-Pb", "AO FK Zenit Sankt-Peterburg"),
    ("Shakhtar D.", "FC Shakhtar Donetsk"),
    ("Sporting", "Sporting CP"),
    ("Inter", "Inter Milan"),
    ("Swansea", "Swansea City"),
    ("Cardiff", "Cardiff City"),
    ("Norwich", "Norwich City"),
    ("Wigan", "Wigan Athletic"),
    ("Huddersfield", "Huddersfield Town"),
    ("Wolves", "Wolverhampton Wanderers"),
    ("QPR", "Queens Park Rangers"),
    ("Nottingham Forest", "Nott'm Forest", "Nottm Forest"),
    ("Frankfurt", "Eintracht Frankfurt", "E. Frankfurt"),
    ("Mönchengladbach", "Borussia Mönchengladbach", "Bor. M'gladbach"),
    ("Hoffenheim", "TSG Hoffenheim", "TSG 1899 Hoffenheim"),
    ("Atlético", "Atlético de Madrid", "Atlético Madrid"),
    ("Bologna", "Bologna Football Club 1909"),
    ("Mainz", "1.FSV Mainz 05"),
    ("Lazio", "Società Sportiva Lazio S.p.A."),
    ("Panathinaikos", "Panathinaikos Athlitikos Omilos"),
    ("Willem II", "Willem II Tilburg"),
    ("Karabükspor", "Kardemir Karabükspor"),
    ("Ankaragücü", "MKE Ankaragücü"),
    ("Leipzig", "RB Leipzig"),
    ("Salzburg", "RB Salzburg"),
    ("Montpellier", "Montpellier HSC"),
    ("Twente FC", "FC Twente", "FC Twente Enschede"),
    ("Estoril", "Estoril Praia", "GD Estoril Praia"),
    ("Vitesse", "Vitesse Arnhem"),
    ("Excelsior", "Excelsior Rotterdam"),
    ("Panionios", "Panionios Athens"),
    ("SönderjyskE", "Sönderjyske", "Sönderjyske Fodbold"),
    ("Roda JC", "Roda JC Kerkrade"),
    ("Dnipro", "Dnipro Dnipropetrovsk (-2020)"),
    ("Kryvbas", "Kryvbas Kryvyi Rig"),
    ("Belenenses", "CF Os Belenenses"),
    ("Chornomorets", "Chornomorets Odesa"),
    ("Panetolikos", "Panetolikos Agrinio"),
    ("Platanias", "AO Platanias"),
    ("Guingamp", "EA Guingamp"),
    ("PAS Lamia", "PAS Lamia 1964"),
    ("Marítimo", "CS Marítimo"),
    ("Panthrakikos", "Panthrakikos Komotini"),
    ("Iraklis", "Iraklis Thessaloniki"),
    ("Pescara", "Delfino Pescara 1936"),
    ("De Graafschap", "De Graafschap Doetinchem"),
    ("FC Ingolstadt", "FC Ingolstadt 04"),
    ("Zirka", "Zirka Kropyvnytskyi"),
    ("Enisey", "Enisey Krasnoyarsk"),
    ("Dinamo Zagreb", "GNK Dinamo Zagreb"),
    ("Xanthi", "AO Xanthi"),
    ("Karagümrük", "Fatih Karagümrük"),
    ("Coimbra", "Académica Coimbra"),
    ("Basel", "FC Basel", "FC Basel 1893"),
    ("Red Star", "Red Star Belgrade"),
    ("Malmö", "Malmö FF"),
    ("Young Boys", "BSC Young Boys"),
    ("Greuther Fürth", "SpVgg Greuther Fürth"),
    ("Kallithea", "Athens Kallithea"),
    ("Rosenborg", "Rosenborg Ballklub", "Rosenborg BK"),
    ("Sarpsborg 08", "Sarpsborg 08 Fotballforening"),
    ("Ergotelis", "GS Ergotelis"),
    ("União Madeira", "CF União Madeira (-2021)"),
    ("Stal Kamyanske", "PFK Stal Kamyanske (-2018)"),
    ("Ingulets", "Ingulets Petrove"),
    ("Clermont Foot", "Clermont Foot 63"),
    ("Desna", "Desna Chernigiv"),
    ("Tambov", "PFK Tambov (-2021)"),
    ("Karpaty Lviv", "Karpaty Lviv (-2021)"),
    ("Anzhi", "Anzhi Makhachkala ( -2022)"),
    ("KSC Lokeren", "KSC Lokeren (- 2020)"),
    ("Gaziantepspor", "Gaziantepspor (- 2020)"),
    ("Mordovia", "Mordovia Saransk (-2020)"),
    ("Desportivo Aves", "Desportivo Aves (- 2020)"),
    ("Lierse SK", "Lierse SK (- 2018)"),
    ("Mouscron", "Royal Excel Mouscron (-2022)"),
    ("RAEC Mons", "RAEC Mons (- 2015)"),
    ("Tosno", "FC Tosno (-2018)"),
    ("SC Paderborn", "SC Paderborn 07"),
    ("Metalist Kharkiv", "Metalist Kharkiv (- 2016)"),
    ("Roma", "AS Roma", "Associazione Sportiva Roma"),
    ("Leverkusen", "Bayer 04 Leverkusen", "B. Leverkusen"),
    ("Parma", "Parma Calcio 1913"),
    ("Atromitos", "APS Atromitos Athinon"),
    ("PAOK", "PAOK Salonika"),
    ("Akhmat Grozny", "RFK Akhmat Grozny"),
    ("Alavés", "Deportivo Alavés"),
    ("Stade Brestois", "Stade Brestois 29"),
    ("Troyes", "ESTAC Troyes"),
    ("Ural", "Ural Yekaterinburg"),
    ("Salernitana", "US Salernitana 1919"),
    ("Khimki", "FC Khimki (-2025)"),
    ("Levadiakos", "APO Levadiakos", "APO Levadiakos Football Club"),
    ("Kuban Krasnodar", "Kuban Krasnodar (-2018)"),
    ("Dijon", "Dijon FCO"),
    ("Veres Rivne", "NK Veres Rivne"),
    ("SC Cambuur", "SC Cambuur Leeuwarden"),
    ("Évian", "Thonon Évian Grand Genève FC"),
    ("Partizan", "FK Partizan Belgrade"),
    ("Apollon Smyrnis", "Apollon Smyrni"),
    ("Ionikos Nikeas", "Ionikos Nikea"),
    ("FC Mariupol", "FK Mariupol", "FSC Mariupol"),
    ("Dynamo Moscow", "Dinamo Moscow"),
    ("Beerschot VA", "Beerschot V.A."),
    ("FC Helsingör", "FC Helsingør"),
    ("Niki Volou", "Niki Volos"),
    ("PFC Lviv", "PFK Lviv"),
    ("Yeni Malatyaspor", "Y. Malatyaspor"),
    ("GFC Ajaccio", "G. Ajaccio"),
    ("Aris Saloniki", "Aris Thessalonikis"),
    ("Arm. Bielefeld", "Arminia Bielefeld"),
    ("Sint-Truiden", "Sint-Truidense VV"),
    ("A.G.S Asteras Tripolis", "Asteras Tripoli"),
    ("Aalesund", "Aalesunds FK"),
)

# --- Fixed values: report gates and display. ---------------------------------
MIN_CLUB_MOVES = 5
MIN_CLUB_RESALES = 3
MIN_CLUB_POSITION = 3
MIN_LEAGUE_MOVES = 15
MIN_LEAGUE_YEAR = 5
ERA_YEARS = 3
TOP_PARTNERS = 8
MIN_YEAR_PREDICTIONS = 10
LAST_RESORT_BASELINE = 0.3
EXCHANGE_RATES = {"EUR": (1.0, "€"), "USD": (1.16, "$"), "GBP": (0.86, "£")}
# Display words; own wording, any other will do.
COMPONENT_LABELS = {
    "value_for_money": "Price paid", "value_growth": "Growth in value", "resale_profit": "Profit on resale",
    "perf_level": "Scoring level", "perf_delta": "Scoring against before", "attacking": "Attack",
    "possession": "Ball play", "defensive": "Defence", "rating": "Provider rating",
    "playing_time": "Share of games",
}
KEEPER_DEFENSIVE_LABEL = "Keeping"
FEATURE_LABELS = {
    "age_at_transfer": "Age when moving",
    "height_vs_position": "Height against peers",
    "pre_playing_time": "Share of games before",
    "pre_apps": "Games before",
    "pre_minutes": "Minutes before",
    "pre_goals_p90": "Goals per 90 before",
    "pre_ga_p90": "Goals and assists per 90 before",
    "pre_mins_per_app": "Minutes a game before",
    "log_transfer_fee": "Price paid",
    "log_value_before": "Market value when moving",
    "fee_to_value_ratio": "Price over market value",
    "club_quality_ratio": "New club against old club",
    "log_from_club_value": "Squad value of the old club",
    "log_to_club_value": "Squad value of the new club",
    "position": "Line of play",
    "sub_position": "Role in the line",
    "foot": "Stronger foot",
    "from_domestic_competition_id": "League left",
    "to_domestic_competition_id": "League joined",
    "pre_fotmob_rating_pct": "Provider rating before",
    "pre_fotmob_attacking_pct": "Attack before",
    "pre_fotmob_defensive_pct": "Defence before",
    "pre_fotmob_possession_pct": "Ball play before",
}
