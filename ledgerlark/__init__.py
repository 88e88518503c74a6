"""Spark-native disclosure, time-series and probability analytics, and operators for large text collections."""

from ledgerlark.operators.contracts import violations
from ledgerlark.operators.filings import index_filings, listing_rows, table_trades, text_trades
from ledgerlark.operators.joins import asof_join, enrich, roster_lookup
from ledgerlark.operators.probability import confidence, devig, divergence, full_results, knockout, markets, predict, score_matrix, style_rho
from ledgerlark.operators.returns import buy_returns
from ledgerlark.operators.upserts import upsert
from ledgerlark.operators.views import TradeQuery, page

__all__ = [
    "TradeQuery", "asof_join", "buy_returns", "confidence", "devig", "divergence", "enrich", "full_results", "index_filings", "knockout", "listing_rows", "markets", "page", "predict",
    "roster_lookup", "score_matrix", "style_rho", "table_trades", "text_trades", "upsert", "violations",
]
