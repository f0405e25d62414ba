"""Small report files used by several tests."""

import csv
import io

FLAT = """Account,Account #,Ticker,Shares,Purchase Date,Unit Cost ($),Cost Basis ($),Value ($),Asset Type
Main,00123,AAA,10,01/15/2020,100.00,"1,000.00","1,500.00",Equity
Main,00123,BBB,5,2021-03-01,20.00,,250.00,Equity
Main,00123,AAA,10,01/15/2020,100.00,"1,000.00","1,500.00",Equity
"""
SEVERAL = """Positions report
Acct No: 777

Filter,Setting
Currency,USD

Symbol,Qty,Date Acquired,Price,Market Value
CCC,4,02/01/2022,50,260
short row
"""
HYBRID = """Account Summary
Account,Net Account Value,Total Gain $
Brokerage-9,100000,2500

Symbol,Date Acquired,Qty #,Price Paid $,Total Cost,Value $
AAA,,30,,3000,4500
,01/15/2020,10,100,1000,1500
,06/01/2021,20,100,2000,3000
BBB,,5,,100,250
,03/01/2021,5,20,100,250
TOTAL,,,,3100,4750
"""
GROUPED = """Description,Symbol,Quantity,Initial Purchase Date,Unit Cost ($),Cost Basis ($),Value ($),Fund Category
Mutual Fund,,,,,,,
Alpha Corp,AAA,30,,,3000,4500,Equity
Joint-1,,10,01/15/2020,100,1000,1500,Equity
Joint-2,,20,06/01/2021,100,2000,3000,Equity
Orphan Corp,ZZZ,1,,,10,11,Equity
Total,,,,,3010,4511,
"""
FILES = {"AA_1.csv": FLAT, "BB_1.csv": SEVERAL, "CC_1.csv": HYBRID, "DD_1.csv": GROUPED, "EE.csv": "note\n"}

# Broker, Account, Account#, Symbol, Quantity, Acquisition Date, Cost per Unit, Total Cost, Value, Type, Source
LOTS = {
    ("AA", "Main", "00123", "AAA", "10", "01/15/2020", "100.00", "1,000.00", "1,500.00", "Equity", None),
    ("AA", "Main", "00123", "BBB", "5", "2021-03-01", "20.00", None, "250.00", "Equity", None),
    ("BB", None, "777", "CCC", "4", "02/01/2022", "50", None, "260", None, None),
    ("BB", None, "777", "short row", None, None, None, None, None, None, None),
    ("CC", "Brokerage-9", None, "AAA", "10", "01/15/2020", "100", "1000", "1500", None, None),
    ("CC", "Brokerage-9", None, "AAA", "20", "06/01/2021", "100", "2000", "3000", None, None),
    ("CC", "Brokerage-9", None, "BBB", "5", "03/01/2021", "20", "100", "250", None, None),
    ("DD", "Joint-1", None, "AAA", "10", "01/15/2020", "100", "1000", "1500", "Equity", None),
    ("DD", "Joint-2", None, "AAA", "20", "06/01/2021", "100", "2000", "3000", "Equity", None),
    ("EE",) + (None,) * 10,
}

GRID_SCHEMA = "file string, sheet_no int, block long, row_no long, cells array<string>"


def grid_of(spark, files, block_rows=1000, sheet_no=0):
    rows = [
        (f"/in/{name}", sheet_no, i // block_rows, i, cells)
        for name, text in files.items()
        for i, cells in enumerate(csv.reader(io.StringIO(text)))
    ]
    return spark.createDataFrame(rows, GRID_SCHEMA)
