"""Fixed values of the ledger format: headers, issue kinds and messages, and the cell schema."""

# Fixed values.
NAME, CODE, DEVICE = "设备小类名称", "设备小类编码", "设备代码"
DATES = ("出厂日期", "启用日期", "设备制造日期")
TARGETS = (NAME, CODE, *DATES, DEVICE)
MESSAGES = {
    "DUPLICATE": "目标表头重复", "NO_CODE": "缺少设备小类编码列，请补充该表头", "MERGED": "目标字段含合并单元格，请先取消合并",
    "FORMULA_RANGE": "目标字段位于公式范围，请先转换为明确值", "FORMULA": "目标字段含公式，请先转换为明确值",
    "NO_NAME": "有编码但缺少设备小类名称，无法匹配", "UNMATCHED": "设备小类名称找不到对应编码", "YEAR_ONLY": "日期只有年份，请补充月份或完整日期",
}
MAPPING_MESSAGES = {
    "UNREADABLE": "无法读取设备小类映射文件", "DUPLICATE": "映射表头重复", "FORMULA": "映射不能使用公式", "BLANK": "名称或编码为空",
    "MANY_CODES": "对应多个编码", "MANY_NAMES": "对应多个名称", "NONE": "映射文件缺少有效的设备小类名称／设备小类编码表",
}
NO_BUSINESS = "没有找到包含目标字段的业务工作表；请确认第 1 行为表头"
#: Cells in long format; absent cells have no row.
CELLS = "path string, sheet_idx int, sheet string, part string, is_1904 boolean, row_num int, col_idx int, coordinate string, cell_type string, raw string, formula string, style_idx int, number_format string"
#: Merged areas and formula ranges.
REGIONS = "path string, sheet_idx int, kind string, ref string, c1 int, r1 int, c2 int, r2 int, formula string"
SHEETS = "path string, sheet_idx int, sheet string, state string, part string, is_1904 boolean, has_data boolean"
