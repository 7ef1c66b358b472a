"""One object with the tables and every report on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shoplens.functions.timeutil import RecentDays, ReportWindow
from shoplens.plans import funnel, landing, product, summary, variation, visitor
from shoplens.session import configure
from shoplens.sources.tables import read_tables


@dataclass(frozen=True)
class Shop:
    """The shop tables; each method is a lazy report over all tenants.

    Filter a report by ``client_id`` (and ``experiment_id``) to see one tenant.
    """

    clients: DataFrame
    experiments: DataFrame
    variations: DataFrame
    events: DataFrame
    visits: DataFrame
    products: DataFrame
    orders: DataFrame
    cookies: DataFrame
    visitors: DataFrame
    regions: DataFrame

    @classmethod
    def stored(cls, spark: SparkSession, root: str) -> Shop:
        """The tables under a root folder."""
        return cls(**read_tables(configure(spark), root))

    def shop_funnel(self, window: ReportWindow) -> DataFrame:
        return funnel.shop_funnel(self.visits, self.orders, self.clients, window)

    def funnel_churn(self, window: ReportWindow) -> DataFrame:
        return funnel.funnel_churn(self.visits, self.orders, self.clients, window)

    def landing_page_conversion(self, window: ReportWindow) -> DataFrame:
        return landing.landing_page_conversion(self.visits, self.orders, self.clients, window)

    def landing_worst(self, window: ReportWindow) -> DataFrame:
        return landing.landing_worst(self.visits, self.orders, self.clients, window)

    def product_conversion_by_tag(self, window: ReportWindow) -> DataFrame:
        return product.product_conversion_by_tag(self.products, self.visits, self.orders, self.clients, window)

    def product_worst_by_tag(self, window: ReportWindow) -> DataFrame:
        return product.product_worst_by_tag(self.products, self.visits, self.orders, self.clients, window)

    def conversion_table(self) -> DataFrame:
        return variation.conversion_table(self.variations, self.experiments, self.events, self.orders, self.cookies)

    def conversion_over_time(self, days: RecentDays) -> DataFrame:
        return variation.conversion_over_time(
            self.variations, self.clients, self.events, self.orders, self.cookies, days
        )

    def conversion_series(self, days: RecentDays) -> DataFrame:
        return variation.conversion_series(self.conversion_over_time(days))

    def experiment_summary(self, confidence_cap: float = 99.99, confidence_threshold: float = 95.0) -> DataFrame:
        goals = variation.goal_table(self.variations, self.events)
        return summary.experiment_summary(self.experiments, self.events, goals, confidence_cap, confidence_threshold)

    def visitor_orders(self, window: ReportWindow) -> DataFrame:
        return visitor.visitor_orders(self.visitors, self.orders, self.cookies, self.clients, window)

    def sales_by_dimension(self, window: ReportWindow) -> DataFrame:
        return visitor.sales_by_dimension(self.visitor_orders(window))

    def sales_by_region(self, window: ReportWindow) -> DataFrame:
        return visitor.sales_by_region(self.visitor_orders(window), self.regions)
