"""Texts for the queries over free text: templates that together take every branch, filled in from the keys of a table.
The expressions read alike in Spark and in DuckDB."""

from __future__ import annotations

ASKED = (
    "kya loan milega bro, salary {n}00 aur cibil score {n}",
    "am I eligible for axis loan, age {a}, salary {n}k, cibil {n}",
    "compare hdfc and sbi for {a}k salary",
    "{a} lpa freelancer wants the best home loan",
    "dti of {a}% cibil {n}",
    "what score do i need",
    "what is the minimum salary for icici personal loan",
    "mil sakta hai kya? income ₹{n}00, {a} years old",
    "mil jayega loan jaldi chahiye yaar, earning {n}45 per month",
    "need urgent car loan, aged {a}, self-employed",
    "I am {a} and earn {n},500 monthly, government job",
    "which documents does state bank want, pan card and form 16?",
    "processing fee and foreclosure charges of icici",
    "interest rate vs emi, axis axis SBI",
    "will i get approved with credit score of {n}? {a} years of experience",
    "no job, no income, can i apply",
    "doctor with {a} years experience, income of {n}000",
    "{n} salaried working in service",
    "gold loan kitna? saal {a}",
    "housing loan for a chartered accountant, dti is {a}",
    "education loan pe best rate kaun sa bank",
    "business loan for proprietor, credit score = {n}, Axis",
    "auto loan dude, salary of ₹{n}00 and age: {a}",
    "cheapest and safest bank, sbi or hdfc or axis",
    "is {a} too old? psu employed, cibil is {n}",
    "   hello   there ",
    "papers to submit, kyc and itr proof needed for a loan",
    "nahi hoga, penalty of prepayment",
    "salary {n} age {n} dti {a}%",
    "roi at {a}.5% p.a., urgent loan, get a loan quickly at the lowest rate",
)

WRITTEN = (
    "₹{a} lakh", "{a}.5 crore", "{n}k", "₹{n},000/month", "{a} thousand", "Rs {n}00", "10.{a}% – 24%", "{a}.5% to 10.5 %", "Starting 10.5% only", "12% or 9.75% or {a}%", "{n}%",
    "{a} years", "{n} months", "7.5 yr", "1 to {a} years", "12–{n} months", "{a}", "{a} - {a} mo", "up to {a} years tenure", "21 to {a} years", "{a}-58", "Minimum {a} years", "at least {a}", "between {a} and 60 and 33 years",
    "{a} LPA", "4.5 lakh per annum", "₹{a}k monthly", "Rs. {n},00 per month", "{n}000 pa", "1234567", "cibil {n}+", "score 3{a} or {n}",
    "Salaried, self-employed and business", "doctors, CA or professional", "govt / psu / public sector, NRI", "salary earners, employed", "none of these",
)

TOLD = (
    "Minimum monthly income of ₹{n},000 per month. Age between 21 and {a} years. CIBIL score 7{a}. Interest rate {a}.5% to 24%.",
    "Personal loan up to ₹{n},000 to ₹{n},000,000. Tenure of 12 to {n} months. Processing fee of 2.5 %. Salaried or self employed.",
    "income should be {n}00 at least, age 2{a} years, credit score above {n}+",
    "monthly salary above {n}99, minimum age of {a} years, tenure: up to 5 year, processing charge: {a} %",
    "borrow {a} lakh – {n} lakh; min salary: {a} lpa; nothing else",
    "loan of 500 to 100 for nri",
    "no numbers here",
)

UPLOADED = (
    "Salary Slip. Employee Name: Asha Rao\nNet Pay: ₹{n}00.50 Gross salary {n}000 PAN ABCDE{y}F Employer: Blue Kite Works Pvt Ltd.",
    "Credit Information Report cibil score: {n} DOB: 0{d}/1{d}/19{a} Closing balance ₹{n},100.25",
    "Bank statement of {y}. Salary credited {n}00. Available balance - {n}99. transaction list",
    "Income Tax Return, assessment year {y}. Gross total income {n}000 and CTC ₹{n},500. Partnership LLP, age {a} years",
    "Form 26AS for a government servant, {a} years of service, {n} credit points, score 2{a} then CIBIL of 7{a}",
    "Dear Mr. Ravi Kumar, your loan amount: {n}00 at dti ratio {a}%. Experience: {a} years 7 months. pay slip",
    "name of applicant : Meera Devi Shah\nDate of joining: 1{d}-0{d}-20{a}, company Acme & Co., monthly income {n}",
    "{a} LPA engineer, sanction {n}000 emi to income 0.{a}, current balance 0, paid by Northern Lights Ltd",
    "annual package 1,{n},000, {a} years old, tenure {d} years",
    "A letter without any of it",
    "date of birth 3{d}.13.19{a}, net salary 12, net salary ₹{n}0000, payslip",
)


def pick(table: tuple[str, ...], key: str) -> str:
    """SQL for the template of a key, filled in."""
    out = "case " + f"{key} % {len(table)} " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(table)) + " end"
    for mark, value in (("{n}", f"20 + {key} * 37 % 970"), ("{a}", f"11 + {key} * 7 % 88"), ("{y}", f"1000 + {key} * 13 % 9000"), ("{d}", f"1 + {key} % 9")):
        out = f"replace({out}, '{mark}', cast({value} as string))"
    return out
