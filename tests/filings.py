"""Synthetic filings shaped like annual and quarterly reports."""

PAD = "The registrant reports further particulars of its ordinary course in this paragraph. " * 9


def filing(company="Apple Inc.", ticker="AAPL", form="10-K (Annual Report)", date="2022-10-28", quarter="2022Q3", body=""):
    quarter_line = f"Quarter: {quarter}\n" if quarter else ""
    return f"Company: {company}\nTicker: {ticker}\nFiling Type: {form}\nFiling Date: {date}\nReport Period: 2022-09-24\n{quarter_line}CIK: 0000320193\nSource: SEC EDGAR\nURL: https://example.org/{ticker}\n{'=' * 40}\n{body}"


def annual(ticker="AAPL", company="Apple Inc.", words="iPhone"):
    body = (
        f"{ticker.lower()}-20220924false2022FY0000320193--09-24 0000320193us-gaap:CommonStockMember\n"
        "UNITED STATES\nSECURITIES AND EXCHANGE COMMISSION\n\n\n\nFORM 10-K\nCalifornia | | 94-2404110\n"
        "15,908,118,000 shares of common stock outstanding\n"
        f"Item 1.  BusinessThe {words} company. {words} business overview. customers and products. {PAD}\n"
        f"Item 1A.  Risk FactorsThe {words} risks could adversely affect results. {PAD}\n"
        f"as described in Item 1A. Risk Factors above {PAD}\n"
        f"Item 3.  Legal ProceedingsThe company faces {words} litigation and lawsuits. {PAD}\n"
        f"Item 7.  Management's Discussion and AnalysisRevenue of {words} increased. results of operations. {PAD}\n"
        "Net sales   2022    2021\niPhone | 205,489 | 191,973 |\nMac | 40,177 | 35,190 |\nTotal | 394,328 | 365,817 |\n"
        f"Item 8.  Financial StatementsConsolidated statements of {words} income. {PAD}\n"
    )
    return filing(company, ticker, body=body)


def corpus_rows():
    rows = [("AAPL_10K_2022Q3_2022-10-28", annual())]
    rows.append(("TSLA_10K_2022Q3_2022-10-28", annual("TSLA", "Tesla, Inc.", "Model")))
    rows.append(("JPM_10K_2022Q3_2022-10-28", annual("JPM", "JPMorgan Chase & Co.", "bank")))
    return rows
