"""Source column names per dataset and the canonical names they are stored under."""

from __future__ import annotations

# The alias maps below spell source names exactly as the data provider does, old and new
# spellings side by side, in the order of the stored columns.

EQUITY_MASTER = {
    "Code": "code",
    "CoName": "company_name",
    "CoNameEn": "company_name_english",
    "S17": "sector17_code",
    "S17Nm": "sector17_name",
    "S33": "sector33_code",
    "S33Nm": "sector33_name",
    "ScaleCat": "scale_category",
    "Mkt": "market_code",
    "MktNm": "market_name",
    "CompanyName": "company_name",
    "CompanyNameEnglish": "company_name_english",
    "Sector17Code": "sector17_code",
    "Sector17CodeName": "sector17_name",
    "Sector33Code": "sector33_code",
    "Sector33CodeName": "sector33_name",
    "ScaleCategory": "scale_category",
    "MarketCode": "market_code",
    "MarketCodeName": "market_name",
}

BARS_LONG = {
    "Date": "date",
    "Code": "code",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
    "TurnoverValue": "turnover_value",
    "AdjustmentFactor": "adjustment_factor",
    "AdjustmentOpen": "adjustment_open",
    "AdjustmentHigh": "adjustment_high",
    "AdjustmentLow": "adjustment_low",
    "AdjustmentClose": "adjustment_close",
    "AdjustmentVolume": "adjustment_volume",
}
BARS_SHORT = {
    "Date": "date",
    "Code": "code",
    "O": "open",
    "H": "high",
    "L": "low",
    "C": "close",
    "Vo": "volume",
    "Va": "turnover_value",
}
MINUTE_LONG = {
    "Date": "date",
    "Code": "code",
    "Time": "time",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
    "TurnoverValue": "turnover_value",
}
MINUTE_SHORT = {
    "Date": "date",
    "Code": "code",
    "Time": "time",
    "O": "open",
    "H": "high",
    "L": "low",
    "C": "close",
    "Vo": "volume",
    "Va": "turnover_value",
}

TOPIX = {
    "Date": "date",
    "O": "open",
    "H": "high",
    "L": "low",
    "C": "close",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
}
INDICES = {
    "Date": "date",
    "Code": "index_code",
    "O": "open",
    "H": "high",
    "L": "low",
    "C": "close",
    "IndexCode": "index_code",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
}

INDEX_OPTIONS = {
    "Date": "date",
    "Code": "code",
    "EmMrgnTrgDiv": "em_mrgn_trg_div",
    "O": "day_open",
    "H": "day_high",
    "L": "day_low",
    "C": "day_close",
    "EO": "night_open",
    "EH": "night_high",
    "EL": "night_low",
    "EC": "night_close",
    "WhDayOP": "whole_day_open",
    "WhDayHiP": "whole_day_high",
    "WhDayLoP": "whole_day_low",
    "WhDayCP": "whole_day_close",
    "NgtSsnOP": "night_session_open",
    "NgtSsnHiP": "night_session_high",
    "NgtSsnLoP": "night_session_low",
    "NgtSsnCP": "night_session_close",
    "DaySsnOP": "day_session_open",
    "DaySsnHiP": "day_session_high",
    "DaySsnLoP": "day_session_low",
    "DaySsnCP": "day_session_close",
    "SettlementPrice": "settlement_price",
    "TheoreticalPrice": "theoretical_price",
    "BaseVolatility": "base_volatility",
    "UnderlyingPrice": "underlying_price",
    "ImpliedVolatility": "implied_volatility",
    "InterestRate": "interest_rate",
    "OpenInterest": "open_interest",
    "TurnoverValue": "turnover_value",
    "TradingVolume": "trading_volume",
    "ContractMonth": "contract_month",
    "StrikePrice": "strike_price",
    "PutCallDivision": "put_call_division",
    "LastTradingDay": "last_trading_day",
    "SpecialQuotationDay": "special_quotation_day",
    "VolumeOnlyAuction": "volume_only_auction",
    "CentralContractMonthFlag": "central_contract_month_flag",
}

MARGIN_INTEREST = {
    "Date": "date",
    "Code": "code",
    "LongMarginTradeVolume": "long_margin_trade_volume",
    "LongMarginTradeValue": "long_margin_trade_value",
    "ShortMarginTradeVolume": "short_margin_trade_volume",
    "ShortMarginTradeValue": "short_margin_trade_value",
    "LongNegotiableMarginTradeVolume": "long_negotiable_margin_trade_volume",
    "LongNegotiableMarginTradeValue": "long_negotiable_margin_trade_value",
    "ShortNegotiableMarginTradeVolume": "short_negotiable_margin_trade_volume",
    "ShortNegotiableMarginTradeValue": "short_negotiable_margin_trade_value",
    "LongVol": "long_margin_trade_volume",
    "ShrtVol": "short_margin_trade_volume",
    "LongNegVol": "long_negotiable_margin_trade_volume",
    "ShrtNegVol": "short_negotiable_margin_trade_volume",
    "LongStdVol": "long_standard_margin_trade_volume",
    "ShrtStdVol": "short_standard_margin_trade_volume",
    "IssType": "issue_type",
}

SHORT_SELLING = {
    "Date": "date",
    "Sector33Code": "sector33_code",
    "SellingValue": "sell_excluding_short_value",
    "ShortSellingWithRestrictionsValue": "short_with_restriction_value",
    "ShortSellingWithoutRestrictionsValue": "short_no_restriction_value",
    "S33": "sector33_code",
    "SellExShortVa": "sell_excluding_short_value",
    "ShrtWithResVa": "short_with_restriction_value",
    "ShrtNoResVa": "short_no_restriction_value",
}

INVESTOR_TYPES = {
    "PublishedDate": "published_date",
    "StartDate": "start_date",
    "EndDate": "end_date",
    "Section": "section",
    "ProprietorsSellValue": "proprietors_sell_value",
    "ProprietorsBuyValue": "proprietors_buy_value",
    "ForeignersSellValue": "foreigners_sell_value",
    "ForeignersBuyValue": "foreigners_buy_value",
    "IndividualsSellValue": "individuals_sell_value",
    "IndividualsBuyValue": "individuals_buy_value",
    "SecuritiesCosSellValue": "securities_cos_sell_value",
    "SecuritiesCosBuyValue": "securities_cos_buy_value",
    "InvestmentTrustsSellValue": "investment_trusts_sell_value",
    "InvestmentTrustsBuyValue": "investment_trusts_buy_value",
    "OtherCorpsSellValue": "other_corps_sell_value",
    "OtherCorpsBuyValue": "other_corps_buy_value",
}

EARNINGS_CALENDAR = {
    "Date": "date",
    "Code": "code",
    "CoName": "company_name",
    "FY": "fiscal_year",
    "FQ": "fiscal_quarter",
    "SectorNm": "sector_name",
    "Section": "section",
    "CompanyName": "company_name",
    "FiscalYearEnd": "fiscal_year",
}

SHORT_SALE_REPORT = {
    "DiscDate": "disc_date",
    "CalcDate": "calc_date",
    "Code": "code",
    "SSName": "ss_name",
    "SSAddr": "ss_addr",
    "DICName": "dic_name",
    "DICAddr": "dic_addr",
    "FundName": "fund_name",
    "ShrtPosToSO": "shrt_pos_to_so",
    "ShrtPosShares": "shrt_pos_shares",
    "ShrtPosUnits": "shrt_pos_units",
    "PrevRptDate": "prev_rpt_date",
    "PrevRptRatio": "prev_rpt_ratio",
    "Notes": "notes",
}

DAILY_MARGIN = {
    "PubDate": "pub_date",
    "Code": "code",
    "AppDate": "app_date",
    "ShrtOut": "shrt_out",
    "ShrtOutChg": "shrt_out_chg",
    "ShrtOutRatio": "shrt_out_ratio",
    "LongOut": "long_out",
    "LongOutChg": "long_out_chg",
    "LongOutRatio": "long_out_ratio",
    "SLRatio": "sl_ratio",
    "ShrtNegOut": "shrt_neg_out",
    "ShrtNegOutChg": "shrt_neg_out_chg",
    "ShrtStdOut": "shrt_std_out",
    "ShrtStdOutChg": "shrt_std_out_chg",
    "LongNegOut": "long_neg_out",
    "LongNegOutChg": "long_neg_out_chg",
    "LongStdOut": "long_std_out",
    "LongStdOutChg": "long_std_out_chg",
    "TSEMrgnRegCls": "tse_mrgn_reg_cls",
}
PUB_REASON = {
    "Restricted": "pub_reason_restricted",
    "DailyPublication": "pub_reason_daily_publication",
    "Monitoring": "pub_reason_monitoring",
    "RestrictedByJSF": "pub_reason_restricted_by_jsf",
    "PrecautionByJSF": "pub_reason_precaution_by_jsf",
    "UnclearOrSecOnAlert": "pub_reason_unclear_or_sec_on_alert",
}

TRADING_CALENDAR = {"Date": "date", "HolDiv": "hol_div"}

FINANCIAL_SUMMARY = {
    # disclosure
    "DiscDate": "disclosed_date",
    "DiscTime": "disclosed_time",
    "Code": "code",
    "DiscNo": "disclosure_number",
    "DocType": "document_type",
    # periods
    "CurPerType": "current_period_type",
    "CurPerSt": "current_period_start",
    "CurPerEn": "current_period_end",
    "CurFYSt": "current_fy_start",
    "CurFYEn": "current_fy_end",
    "NxtFYSt": "next_fy_start",
    "NxtFYEn": "next_fy_end",
    # results and balance sheet
    "Sales": "net_sales",
    "OP": "operating_profit",
    "OdP": "ordinary_profit",
    "NP": "net_income",
    "EPS": "eps",
    "DEPS": "diluted_eps",
    "TA": "total_assets",
    "Eq": "equity",
    "EqAR": "equity_to_asset_ratio",
    "BPS": "bps",
    # cash flow
    "CFO": "cf_operating",
    "CFI": "cf_investing",
    "CFF": "cf_financing",
    "CashEq": "cash_and_equivalents",
    # dividends paid
    "Div1Q": "dividend_q1",
    "Div2Q": "dividend_q2",
    "Div3Q": "dividend_q3",
    "DivFY": "dividend_fy_end",
    "DivAnn": "dividend_annual",
    "DivUnit": "distributions_per_unit",
    "DivTotalAnn": "total_dividend_paid",
    "PayoutRatioAnn": "payout_ratio",
    # dividend forecast, this year
    "FDiv1Q": "forecast_dividend_q1",
    "FDiv2Q": "forecast_dividend_q2",
    "FDiv3Q": "forecast_dividend_q3",
    "FDivFY": "forecast_dividend_fy",
    "FDivAnn": "forecast_dividend_annual",
    "FDivUnit": "forecast_distributions_unit",
    "FDivTotalAnn": "forecast_total_dividend_paid",
    "FPayoutRatioAnn": "forecast_payout_ratio",
    # dividend forecast, next year
    "NxFDiv1Q": "next_forecast_dividend_q1",
    "NxFDiv2Q": "next_forecast_dividend_q2",
    "NxFDiv3Q": "next_forecast_dividend_q3",
    "NxFDivFY": "next_forecast_dividend_fy",
    "NxFDivAnn": "next_forecast_dividend_annual",
    "NxFDivUnit": "next_forecast_distributions_unit",
    "NxFPayoutRatioAnn": "next_forecast_payout_ratio",
    # forecasts, half year
    "FSales2Q": "forecast_sales_2q",
    "FOP2Q": "forecast_op_2q",
    "FOdP2Q": "forecast_ordinary_2q",
    "FNP2Q": "forecast_net_income_2q",
    "FEPS2Q": "forecast_eps_2q",
    "NxFSales2Q": "next_forecast_sales_2q",
    "NxFOP2Q": "next_forecast_op_2q",
    "NxFOdP2Q": "next_forecast_ordinary_2q",
    "NxFNp2Q": "next_forecast_net_income_2q",
    "NxFEPS2Q": "next_forecast_eps_2q",
    # forecasts, full year
    "FSales": "forecast_sales",
    "FOP": "forecast_op",
    "FOdP": "forecast_ordinary",
    "FNP": "forecast_net_income",
    "FEPS": "forecast_eps",
    "NxFSales": "next_forecast_sales",
    "NxFOP": "next_forecast_op",
    "NxFOdP": "next_forecast_ordinary",
    "NxFNp": "next_forecast_net_income",
    "NxFEPS": "next_forecast_eps",
    # changes in accounting
    "MatChgSub": "material_changes_subsidiaries",
    "SigChgInC": "changes_consolidation_scope",
    "ChgByASRev": "changes_accounting_standard",
    "ChgNoASRev": "changes_other_accounting",
    "ChgAcEst": "changes_accounting_estimates",
    "RetroRst": "retrospective_restatement",
    # shares
    "ShOutFY": "shares_outstanding",
    "TrShFY": "treasury_stock",
    "AvgSh": "avg_shares",
    # parent company only
    "NCSales": "nc_net_sales",
    "NCOP": "nc_operating_profit",
    "NCOdP": "nc_ordinary_profit",
    "NCNP": "nc_net_income",
    "NCEPS": "nc_eps",
    "NCTA": "nc_total_assets",
    "NCEq": "nc_equity",
    "NCEqAR": "nc_equity_to_asset_ratio",
    "NCBPS": "nc_bps",
    "FNCSales2Q": "forecast_nc_sales_2q",
    "FNCOP2Q": "forecast_nc_op_2q",
    "FNCOdP2Q": "forecast_nc_ordinary_2q",
    "FNCNP2Q": "forecast_nc_net_income_2q",
    "FNCEPS2Q": "forecast_nc_eps_2q",
    "NxFNCSales2Q": "next_forecast_nc_sales_2q",
    "NxFNCOP2Q": "next_forecast_nc_op_2q",
    "NxFNCOdP2Q": "next_forecast_nc_ordinary_2q",
    "NxFNCNP2Q": "next_forecast_nc_net_income_2q",
    "NxFNCEPS2Q": "next_forecast_nc_eps_2q",
    "FNCSales": "forecast_nc_sales",
    "FNCOP": "forecast_nc_op",
    "FNCOdP": "forecast_nc_ordinary",
    "FNCNP": "forecast_nc_net_income",
    "FNCEPS": "forecast_nc_eps",
    "NxFNCSales": "next_forecast_nc_sales",
    "NxFNCOP": "next_forecast_nc_op",
    "NxFNCOdP": "next_forecast_nc_ordinary",
    "NxFNCNP": "next_forecast_nc_net_income",
    "NxFNCEPS": "next_forecast_nc_eps",
}
FINANCIAL_DATES = (
    "disclosed_date",
    "current_period_start",
    "current_period_end",
    "current_fy_start",
    "current_fy_end",
    "next_fy_start",
    "next_fy_end",
)
FINANCIAL_TEXTS = (
    "disclosed_time",
    "code",
    "disclosure_number",
    "document_type",
    "current_period_type",
    "material_changes_subsidiaries",
    "changes_consolidation_scope",
    "changes_accounting_standard",
    "changes_other_accounting",
    "changes_accounting_estimates",
    "retrospective_restatement",
)

DATABASES = ("raw", "analytics", "master", "portfolio")

# Stored tables that no job here fills; created empty so that every namespace is complete.
EMPTY_TABLES = """
CREATE TABLE IF NOT EXISTS {master}.manual_fundamentals (
  code STRING, fiscal_year STRING, roic DOUBLE, fcf DOUBLE, equity_ratio DOUBLE, interest_bearing_debt DOUBLE,
  interest_coverage_ratio DOUBLE, notes STRING, updated_at TIMESTAMP) USING parquet;
CREATE TABLE IF NOT EXISTS {portfolio}.holdings (
  code STRING, account_type STRING, quantity BIGINT, avg_cost DOUBLE, purchase_date DATE, stop_loss_price DOUBLE,
  target_price_1 DOUBLE, target_price_2 DOUBLE, notes STRING, is_active BOOLEAN, _updated_at TIMESTAMP) USING parquet;
CREATE TABLE IF NOT EXISTS {portfolio}.watchlist (
  code STRING, added_date DATE, framework_score DOUBLE, entry_trigger STRING, priority STRING, status STRING,
  notes STRING, _updated_at TIMESTAMP) USING parquet;
CREATE TABLE IF NOT EXISTS {portfolio}.asset_history (
  month DATE, nisa_growth DOUBLE, nisa_tsumitate DOUBLE, individual_stocks DOUBLE, cash DOUBLE, other_assets DOUBLE,
  total_assets DOUBLE, housing_loan_balance DOUBLE, net_assets DOUBLE, notes STRING, _updated_at TIMESTAMP) USING parquet;
CREATE TABLE IF NOT EXISTS {portfolio}.alerts (
  alert_date DATE, code STRING, alert_type STRING, priority STRING, message STRING, is_resolved BOOLEAN,
  _created_at TIMESTAMP) USING parquet;
CREATE TABLE IF NOT EXISTS {analytics}.external_prices (
  fetch_date DATE, ticker STRING, asset_name STRING, asset_type STRING, price_original DOUBLE, currency STRING,
  usdjpy_rate DOUBLE, price_jpy DOUBLE) USING parquet
"""
