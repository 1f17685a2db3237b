"""Prompt texts.

Fixed values: all texts in this module are data that must read exactly like this for the
same prompts (and prompt hashes) to come out. `{name}` marks a placeholder; every other
brace is literal.
"""

from __future__ import annotations

NO_SOLUTION = "Not provided"
NO_CONTEXT = "No context provided"
FUNCTIONS_NOTE = (
    "You have access to a library of financial functions. Use them when relevant to solve the problem."
)

# --- structured templates: name → (system text, user text) -----------------------------

TEMPLATES: dict[str, tuple[str, str]] = {}

TEMPLATES["default"] = (
    """You are a financial reasoning assistant. Answer question step-by-step, showing your work clearly.

For each step:
1. State what you're calculating or looking up
2. Show numbers/formulas you're using
3. Explain why you're doing this step
4. Give intermediate results
5. Finally, provide your final answer in the format: ANSWER: [number]

IMPORTANT: Your final answer must be the last line of your response, formatted exactly as: ANSWER: [number]""",
    """Question: {question}

Context:
{context}

{python_solution}

Instructions:
Use the Python solution as a reference. Break down your reasoning into clear steps.
Output your answer and reasoning in following JSON format:

{
  "final_answer": [your computed answer],
  "reasoning_steps": [
    {
      "step_number": 1,
      "step_type": "variable_definition|calculation|conditional|return_result",
      "description": "[what you did in this step]",
      "code_snippet": "[the actual code or formula]"
    }
  ]
}""",
)

TEMPLATES["cot_rag"] = (
    """You are a financial reasoning assistant with access to a library of financial functions.

Available Functions:
{functions_instructions}

For each step:
1. State what you're calculating or looking up
2. If relevant financial function is available, use it
3. Show your reasoning and calculations clearly
4. Reference any functions you use by name
5. Provide final answer in specified format

IMPORTANT: The available functions are meant to HELP you. Use them when appropriate to the problem.
""",
    """Question: {question}

Context:
{context}

{python_solution}

Available Financial Functions:
{functions}

Instructions:
1. Review the available financial functions above
2. Use relevant functions to help solve the problem
3. Reference any function you use by name (e.g., "Using NPV calculation function")
4. Show your reasoning step-by-step
5. If a function doesn't perfectly match your needs, adapt it or solve manually
6. Output your final answer and reasoning in following JSON format:

{
  "final_answer": [your computed answer],
  "reasoning_steps": [
    {
      "step_number": 1,
      "step_type": "variable_definition|calculation|conditional|return_result",
      "description": "[what you did in this step]",
      "code_snippet": "[the actual code or formula, note if you used a function: function_name]"
    }
  ]
}""",
)

TEMPLATES["pot_rag"] = (
    """You are a financial reasoning assistant with access to a library of financial functions.

Available Functions:
{functions_instructions}

Your task is to write Python code to solve the financial problem:
1. Define all necessary variables
2. Use relevant financial functions when applicable (by function name)
3. Perform calculations step-by-step
4. Include comments explaining each step
5. The final answer should be stored in a variable called 'answer'
6. Use the final statement: return answer

Requirements:
- Only use standard Python libraries (math, statistics if needed)
- For complex calculations, prefer using available financial functions over manual implementation
- Clear variable names matching problem context
- Proper handling of numeric operations
- Include type annotations where helpful
- Comment which financial function you're using (e.g., "# Using NPV calculation function")

Example format:
```python
# Define variables
shares_outstanding = 1328

# Use financial function if available
# from financial_functions import calculate_npv
# npv = calculate_npv(...)

# Calculate answer
answer = shares_outstanding - acquisition_cost

# Return final result
return answer
```

IMPORTANT: Output ONLY as Python code, no explanations outside code block.""",
    """Question: {question}

Context:
{context}

{python_solution}

Available Financial Functions:
{functions}

Instructions:
Write a Python program to solve this financial problem:
1. Define a variable called 'answer' that contains the final computed value
2. Use relevant financial functions when applicable
3. For each function, reference it by name (e.g., "Using calculate_npv function")
4. Show your reasoning step-by-step in code comments
5. Use 'return answer' as the last statement

Output your complete Python program in a code block```python
...```""",
)

TEMPLATES["pot"] = (
    """You are a financial reasoning assistant with strong Python programming skills.

Generate a Python program to solve the given financial problem:
1. Define all necessary variables
2. Perform calculations step-by-step
3. Include comments explaining each step
4. The final answer should be stored in a variable called 'answer'
5. Use the final statement: return answer

Requirements:
- Only use standard Python libraries (math, statistics if needed)
- No external dependencies or imports
- Clear variable names matching the problem context
- Proper handling of numeric operations
- Include type annotations where helpful

Example format:
```python
# Define variables
shares_outstanding = 1328  # shares at end of 2012
acquisition_cost = 176  # cost of Smith International acquisition

# Calculate answer
answer = shares_outstanding - acquisition_cost

# Return final result
return answer
```

IMPORTANT: Output ONLY the Python code, no explanations outside code block.""",
    """Question: {question}

Context:
{context}

{python_solution}

Instructions:
Generate a Python program to solve this financial problem.
Define a variable called 'answer' that contains the final computed value.
Use 'return answer' as the last statement.

Output your complete Python program in a code block```python
...```""",
)

TEMPLATES["compliant"] = (
    """You are a financial reasoning assistant. Answer the question using the provided context and Python solution.

Follow this structured output format:

{
  "final_answer": [number or string],
  "reasoning_steps": [
    {
      "step_number": 1,
      "step_type": "[variable_definition|calculation|conditional|return_result]",
      "description": "...",
      "code_snippet": "..."
    },
    ...
  ]
}

Requirements:
- final_answer: The computed answer (same format as ground_truth)
- reasoning_steps: Array of step objects with step_number, step_type, description, code_snippet
- step_type must be one of: variable_definition, calculation, conditional, return_result
- step_number: Sequential integer starting from 1

Example:
{
  "final_answer": 1152,
  "reasoning_steps": [
    {
      "step_number": 1,
      "step_type": "variable_definition",
      "description": "Define shares_outstanding",
      "code_snippet": "shares_outstanding = 1328"
    },
    {
      "step_number": 2,
      "step_type": "variable_definition",
      "description": "Define acquisition_cost",
      "code_snippet": "acquisition_cost = 176"
    },
    {
      "step_number": 3,
      "step_type": "calculation",
      "description": "Calculate shares after acquisition",
      "code_snippet": "answer = shares_outstanding - acquisition_cost"
    },
    {
      "step_number": 4,
      "step_type": "return_result",
      "description": "Final answer",
      "code_snippet": "return answer"
    }
  ]
}""",
    """Question: {question}

Context:
{context}

{python_solution}

Instructions:
Use the Python solution as a reference. Break down your reasoning into clear steps.
Output your answer and reasoning in the following JSON format:

{
  "final_answer": [your computed answer],
  "reasoning_steps": [
    {
      "step_number": 1,
      "step_type": "variable_definition|calculation|conditional|return_result",
      "description": "[what you did in this step]",
      "code_snippet": "[the actual code or formula]"
    }
  ]
}""",
)

TEMPLATES["cot_only"] = (
    "Think step-by-step and show your work.",
    """Question: {question}

Context:
{context}

{python_solution}

Think step-by-step. Show intermediate calculations.
Final answer format: ANSWER: [number]""",
)

DEFAULT_TEMPLATE = "compliant"
METHOD_TEMPLATES = {
    "cot": "default",
    "pot": "pot",
    "cot_rag": "cot_rag",
    "pot_rag": "pot_rag",
    "cot_only": "cot_only",
    "compliant": "compliant",
}

# --- experiment prompts ----------------------------------------------------------------

COT_SYSTEM = """You are a financial expert, you are supposed to answer the given question. You need to first think through the problem step by step, identifying the exact variables and values, and documenting each necessary step. Then you are required to conclude your response with the final answer in your last sentence as 'Therefore, the answer is {final answer}'. The final answer should be a numeric value."""

COT_PREFIX = """Let's think step by step to answer the given question.
"""

POT_SYSTEM = """You are a financial expert, you are supposed to generate a Python program to answer the given question. The returned value of the program is supposed to be the answer. Here is an example of the Python program:
```python
def solution():
    # Define variables name and value
    revenue = 600000
    avg_account_receivable = 50000

    # Do math calculation to get the answer
    receivables_turnover = revenue / avg_account_receivable
    answer = 365 / receivables_turnover

    # return answer
    return answer
```
"""

POT_PREFIX = """Please generate a Python program to answer the given question. The format of the program should be the following:
```python
def solution():
    # Define variables name and value

    # Do math calculation to get the answer

    # return answer
```

Continue your output:
```python
def solution():
    # Define variables name and value
"""

# --- why was it wrong? -----------------------------------------------------------------

ANALYSIS_PROMPT = """당신은 금융 계산 오류를 분석하는 전문가입니다.
주어진 문제, 정답, 그리고 모델의 오답과 풀이 과정을 보고 왜 틀렸는지 분석해주세요.

반드시 한글로 답변하세요. 쉽고 명확한 표현을 사용하세요.

## 문제
{question}

## 주어진 데이터
{context}

## 정답
{ground_truth}

## 모델의 답
{predicted_answer}

## 모델의 풀이
```
{raw_response}
```

## 분석 요청

1. **오류 유형** (하나 선택):
   - MISUNDERSTANDING: 문제를 잘못 이해함
   - FORMULA_ERROR: 잘못된 공식이나 계산 방법 사용
   - EXTRACTION_ERROR: 데이터에서 잘못된 값을 가져옴
   - CALCULATION_ERROR: 계산 실수
   - UNIT_ERROR: 단위를 혼동함 (예: INR→GBP vs GBP→INR)
   - LOGIC_ERROR: 논리적 오류
   - INCOMPLETE: 풀이가 불완전함

2. **요약**: 무엇이 잘못되었는지 한 문장으로

3. **상세 분석**: 구체적으로 어떤 실수를 했는지

4. **원인**: 모델이 왜 이런 실수를 했을 것 같은지

5. **올바른 풀이**: 어떻게 풀어야 했는지 간단히

다음 형식으로 답변하세요:
ERROR_TYPE: [유형]
SUMMARY: [한 문장 요약]
DETAILED_ANALYSIS: [상세 분석]
LIKELY_CAUSE: [원인]
CORRECT_APPROACH: [올바른 풀이]
CONFIDENCE: [0.0-1.0]
"""

# --- prompts with retrieved functions --------------------------------------------------

ENHANCED_PROMPT = """{prompt}

Available Financial Functions:
{functions}

Instructions:
1. Review the available financial functions above
2. Use relevant functions to help solve the problem
3. Reference functions by name (e.g., "Using calculate_npv function")
4. If no relevant function exists, solve manually
"""
