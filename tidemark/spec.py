"""Fixed tables: metric sets, weights, masks, account map, sector names.

Everything here is a fixed value that decides results; no logic.
"""

from __future__ import annotations

# ---- fixed values: tracks -------------------------------------------------
GENERAL, FINANCE, PHARMA, HOLDING = "T1", "T2", "T3", "T4"

# ---- fixed values: report codes -> quarter ----------------------------------
REPORT_QUARTER = {"11013": 1, "11012": 2, "11014": 3, "11011": 4}
REPORT_MONTH = {"11013": "03", "11012": "06", "11014": "09", "11011": "12"}
ANNUAL_REPORT = "11011"

# ---- fixed values: category -> (metric, weight, direction) -------------------
CATEGORIES = {
    "growth": [("revenue_growth_yoy", 0.35, 1), ("op_growth_yoy", 0.35, 1),
               ("ni_growth_yoy", 0.20, 1), ("growth_volatility", 0.10, -1)],
    "profitability": [("roe", 0.35, 1), ("operating_margin", 0.25, 1), ("roic", 0.20, 1),
                      ("roa", 0.10, 1), ("net_margin", 0.10, 1)],
    "stability": [("debt_ratio", 0.30, -1), ("current_ratio", 0.20, 1),
                  ("ocf_to_ni", 0.25, 1), ("fcf_to_ni", 0.25, 1)],
    "valuation": [("per", 0.30, -1), ("pbr", 0.25, -1), ("ev_ebit", 0.20, -1),
                  ("psr", 0.10, -1), ("fcf_yield", 0.15, 1)],
    "momentum": [("return_3m", 0.35, 1), ("return_1m", 0.25, 1), ("volume_ratio", 0.20, 1),
                 ("return_6m", 0.13, 1), ("disparity_20", 0.07, -1)],
}
CATEGORY_NAMES = list(CATEGORIES)

# ---- fixed values: categories that a track replaces -----------------------------
TRACK_CATEGORIES = {
    FINANCE: {
        "profitability": [("roa", 0.45, 1), ("roe", 0.35, 1), ("net_margin", 0.20, 1)],
        "stability": [("equity_ratio", 1.00, 1)],
        "valuation": [("pbr", 0.50, -1), ("per", 0.30, -1), ("fcf_yield", 0.20, 1)],
    },
    PHARMA: {
        "profitability": [("gp_to_assets", 0.60, 1), ("roa", 0.40, 1)],
        "valuation": [("psr", 0.60, -1), ("pbr", 0.40, -1)],
    },
    HOLDING: {
        "valuation": [("pbr", 0.60, -1), ("ev_ebit", 0.40, -1)],
    },
}

# ---- fixed values: grade cuts -----------------------------------------------------
GRADE_CUTS = [(90, "A+"), (75, "A"), (45, "B"), (20, "C")]

# ---- fixed values: strategy weights -------------------------------------------------
STRATEGY_WEIGHTS = {
    "value": {"valuation": 50, "profitability": 30, "stability": 10, "growth": 10},
    "growth": {"valuation": 35, "profitability": 30, "growth": 25, "stability": 10},
}

# ---- fixed values: metrics that are NULL for a track -----------------------------------
TRACK_NULL_METRICS = {
    FINANCE: ["debt_ratio", "current_ratio", "fcf_ttm", "fcf_to_ni", "operating_margin",
              "ev_ebitda", "net_debt", "net_debt_ebitda"],
    PHARMA: ["per", "peg", "roe", "operating_margin", "normalized_per"],
    HOLDING: ["per", "revenue_growth_yoy"],
}

# ---- fixed values: metrics mixing market value and statement currency -------------------
MIXED_UNIT_METRICS = ["per", "pbr", "psr", "ev", "ev_ebit", "ev_ebitda", "eps", "bps",
                      "fcf_yield", "peg", "normalized_per"]

# ---- fixed values: metrics dropped when stability is distorted ----------------------------
DISTORTED_METRICS = ["debt_ratio", "current_ratio", "net_debt", "net_debt_ebit",
                     "net_debt_ebitda"]

# ---- fixed values: statement fields ---------------------------------------------------------
FLOW_FIELDS = ["revenue", "gross_profit", "operating_income", "pretax_income", "tax_expense",
               "net_income", "net_income_parent", "ocf", "capex_tangible",
               "capex_intangible", "depreciation", "amortization"]
STOCK_FIELDS = ["assets", "current_assets", "liabilities", "current_liabilities", "equity",
                "equity_parent", "cash", "hybrid_capital"]
CAPEX_FIELDS = ["capex_tangible", "capex_intangible"]

# ---- fixed values: account id -> field ----------------------------------------------------------
ACCOUNT_IDS = {
    "ifrs-full_Revenue": "revenue",
    "ifrs-full_RevenueFromContractsWithCustomers": "revenue",
    "ifrs_Revenue": "revenue",
    "ifrs-full_GrossProfit": "gross_profit",
    "ifrs_GrossProfit": "gross_profit",
    "dart_OperatingIncomeLoss": "operating_income",
    "ifrs-full_ProfitLossFromOperatingActivities": "operating_income",
    "ifrs_ProfitLossFromOperatingActivities": "operating_income",
    "ifrs-full_ProfitLossBeforeTax": "pretax_income",
    "ifrs_ProfitLossBeforeTax": "pretax_income",
    "ifrs-full_IncomeTaxExpenseContinuingOperations": "tax_expense",
    "ifrs_IncomeTaxExpenseContinuingOperations": "tax_expense",
    "ifrs-full_ProfitLoss": "net_income",
    "ifrs_ProfitLoss": "net_income",
    "ifrs-full_ProfitLossAttributableToOwnersOfParent": "net_income_parent",
    "ifrs_ProfitLossAttributableToOwnersOfParent": "net_income_parent",
    "ifrs-full_Assets": "assets",
    "ifrs_Assets": "assets",
    "ifrs-full_CurrentAssets": "current_assets",
    "ifrs_CurrentAssets": "current_assets",
    "ifrs-full_Liabilities": "liabilities",
    "ifrs_Liabilities": "liabilities",
    "ifrs-full_CurrentLiabilities": "current_liabilities",
    "ifrs_CurrentLiabilities": "current_liabilities",
    "ifrs-full_Equity": "equity",
    "ifrs_Equity": "equity",
    "ifrs-full_EquityAttributableToOwnersOfParent": "equity_parent",
    "ifrs_EquityAttributableToOwnersOfParent": "equity_parent",
    "ifrs-full_CashAndCashEquivalents": "cash",
    "ifrs_CashAndCashEquivalents": "cash",
    "ifrs-full_CashFlowsFromUsedInOperatingActivities": "ocf",
    "ifrs_CashFlowsFromUsedInOperatingActivities": "ocf",
}

# ---- fixed values: field -> statement divisions and account-name patterns, in order ---------------
ACCOUNT_NAMES = [
    ("revenue", ["IS", "CIS"], ["^매출액$", r"^수익\(매출액\)$", "^영업수익$", "^매출$"]),
    ("gross_profit", ["IS", "CIS"], ["^매출총이익"]),
    ("operating_income", ["IS", "CIS"], ["^영업이익", "^영업손실"]),
    ("pretax_income", ["IS", "CIS"], ["법인세.*차감전.*(순)?이익", "^세전.*이익"]),
    ("tax_expense", ["IS", "CIS"], ["^법인세비용"]),
    ("net_income", ["IS", "CIS"], ["^당기순이익", "^당기순손실", "^분기순이익", "^반기순이익"]),
    ("net_income_parent", ["IS", "CIS"], ["지배기업.*소유주.*지분", "^지배주주"]),
    ("assets", ["BS"], ["^자산총계$"]),
    ("current_assets", ["BS"], ["^유동자산$"]),
    ("liabilities", ["BS"], ["^부채총계$"]),
    ("current_liabilities", ["BS"], ["^유동부채$"]),
    ("equity", ["BS"], ["^자본총계$"]),
    ("equity_parent", ["BS"], ["지배기업.*소유주.*지분", "^지배주주지분"]),
    ("cash", ["BS"], ["^현금및현금성자산"]),
    ("hybrid_capital", ["BS"], ["^신종자본증권", "하이브리드채권", "^기타자본증권$"]),
    ("ocf", ["CF"], ["영업활동.*현금흐름"]),
    ("capex_tangible", ["CF"], ["유형자산.*취득", r"유형자산의\s*증가"]),
    ("capex_intangible", ["CF"], ["무형자산.*취득", r"무형자산의\s*증가"]),
    ("depreciation", ["CF", "IS", "CIS"], ["감가상각", "상각비용"]),
    ("amortization", ["CF", "IS", "CIS"], ["무형자산상각", "무형자산의상각"]),
]
EXCLUDED_ID_TOKENS = "ComprehensiveIncome|OtherComprehensive"
EXCLUDED_NAMES = "포괄|주당"

# ---- fixed values: industry rules for tracks -------------------------------------------------
FINANCE_INDUSTRIES = ["64", "65", "66"]
PHARMA_INDUSTRIES = ["21"]
HOLDING_INDUSTRY = "64992"
FINANCE_NAME = "금융지주|은행|생명|화재|해상|손해보험|증권|캐피탈|카드"
FINANCE_ASSET = "금융업채권|할부금융|운용리스자산|리스채권|금융리스"

# ---- fixed values: two-digit industry -> sector name -----------------------------------------
SECTOR_NAMES = {
    "10": "식료품", "12": "담배", "19": "석유정제", "20": "화학", "21": "의약품",
    "22": "고무·플라스틱", "23": "비금속광물", "24": "1차금속", "25": "금속가공",
    "26": "전자부품·반도체", "27": "의료·정밀기기", "28": "전기장비", "29": "기계·장비",
    "30": "자동차", "31": "운송장비", "35": "전기·가스", "41": "건설", "46": "도매·상품중개",
    "47": "소매", "50": "해운", "51": "항공운송", "52": "창고·운송서비스", "58": "출판·게임",
    "59": "영상·음악", "61": "통신", "62": "소프트웨어", "63": "정보서비스", "64": "금융·지주",
    "65": "보험", "66": "금융투자", "70": "연구개발", "72": "엔지니어링", "75": "사업지원서비스",
    "76": "임대서비스", "96": "기타 개인서비스",
}
UNKNOWN_SECTOR = "미분류"

# ---- fixed values: raw signals for rank correlation, with sign ----------------------------------
RAW_SIGNALS = [("per", -1), ("pbr", -1), ("roe", 1), ("operating_margin", 1), ("debt_ratio", -1),
               ("fcf_to_ni", 1), ("ocf_to_ni", 1), ("revenue_growth_yoy", 1), ("ev_ebit", -1),
               ("revenue_cagr_3y", 1), ("fcf_yield", 1), ("return_3m", 1), ("volume_ratio", 1),
               ("disparity_20", -1)]

# ---- fixed values: facts shown as pros and cons --------------------------------------------------
FACT_METRICS = ["roe", "operating_margin", "roic", "revenue_growth_yoy", "op_growth_yoy",
                "revenue_cagr_3y", "ocf_to_ni", "fcf_to_ni", "debt_ratio", "current_ratio",
                "per", "pbr", "ev_ebit", "fcf_yield", "return_3m"]
