"""Phrases, weights and names that results depend on, kept as data."""

from __future__ import annotations

# Exact phrases looked for in questions.
LEGAL_PHRASES = [
    "miễn tiền chậm nộp", "xử phạt chậm nộp", "chậm nộp thuế", "quản lý thuế quốc tế", "đăng ký thuế", "khai thuế", "nộp thuế",
    "hoàn thuế", "gia hạn nộp thuế", "kiểm tra thuế", "quản lý rủi ro", "cưỡng chế thi hành quyết định hành chính về quản lý thuế",
    "hóa đơn điện tử", "hóa đơn điện tử khởi tạo từ máy tính tiền", "biên lai thu tiền phạt", "tiền chậm nộp phạt", "chậm nộp phạt",
    "hộ kinh doanh", "cá nhân kinh doanh",
]

# Phrases that ask for amended rules.
AMENDMENT_PHRASES = [
    "mới nhất", "hiện hành", "sửa đổi", "đã sửa đổi", "cập nhật", "1 tỷ", "01 tỷ", "500 triệu", "ngưỡng doanh thu", "dưới 1 tỷ", "trên 1 tỷ",
    "doanh thu chịu thuế", "doanh thu bao nhiêu", "vượt ngưỡng", "ngưỡng áp dụng", "ngưỡng hóa đơn",
]

# Phrases of the revenue-threshold topic.
THRESHOLD_PHRASES = [
    "ngưỡng doanh thu", "doanh thu chịu thuế", "mức doanh thu", "1 tỷ", "01 tỷ", "1 tỷ đồng", "01 tỷ đồng", "500 triệu", "500 triệu đồng",
    "dưới 1 tỷ", "trên 1 tỷ", "miễn thuế", "chịu thuế", "doanh thu bao nhiêu", "vượt ngưỡng", "ngưỡng áp dụng", "ngưỡng hóa đơn",
]

# Documents by the phrases that name them; the first match wins.
DOCUMENTS = [
    ("108_2025_QH15", "Luật quản lý thuế 108/2025/QH15", "luật", ["luật quản lý thuế", "108/2025", "108-2025"]),
    ("68_2026_ND_CP", "68-2026-ND-CP", "nghị_định", ["68/2026", "68-2026", "nghị định 68"]),
    ("70_2025_ND_CP", "70-2025-ND-CP", "nghị_định", ["70/2025", "70-2025", "nghị định 70"]),
    ("18_2023_TT_BTC", "Thông tư 18/2023/TT-BTC", "thông_tư", ["18/2023", "18-2023", "thông tư 18"]),
]

# Classes of questions; the first match wins.
INTENTS = [
    ("định_nghĩa", ["là gì", "khái niệm", "định nghĩa", "nội dung là gì", "hiểu như thế nào"]),
    ("điều_kiện", ["trường hợp nào", "điều kiện", "khi nào", "được miễn", "được hoàn", "được giảm"]),
    ("thủ_tục", ["thủ tục", "quy trình", "cách thực hiện", "hồ sơ", "cần giấy tờ gì"]),
    ("xử_phạt", ["xử phạt", "mức phạt", "vi phạm", "chậm nộp phạt", "tiền phạt"]),
    ("nghĩa_vụ", ["nghĩa vụ", "phải làm gì", "trách nhiệm"]),
]
DOCUMENT_TYPES = [
    ("luật", ["luật"]), ("nghị_định", ["nghị định", "nghi dinh"]), ("thông_tư", ["thông tư", "thong tu"]), ("công_văn", ["công văn", "cong van"]),
]
TOPICS = [
    ("quản_lý_thuế", ["quản lý thuế"]), ("hóa_đơn_chứng_từ", ["hóa đơn"]), ("nguong_doanh_thu", THRESHOLD_PHRASES),
    ("hộ_kinh_doanh", ["hộ kinh doanh", "cá nhân kinh doanh"]), ("thu_nộp_tiền_phạt_biên_lai", ["tiền phạt", "biên lai"]),
]
LEGAL_TOPICS = [
    ("nguong_doanh_thu", THRESHOLD_PHRASES), ("mien_tien_cham_nop", ["miễn tiền chậm nộp"]), ("tien_cham_nop_phat", ["tiền chậm nộp phạt", "chậm nộp phạt"]),
    ("hoa_don_may_tinh_tien", ["hóa đơn điện tử khởi tạo từ máy tính tiền", "máy tính tiền"]), ("hoa_don_dien_tu", ["hóa đơn điện tử"]),
    ("ho_kinh_doanh", ["hộ kinh doanh", "cá nhân kinh doanh"]), ("dang_ky_thue", ["đăng ký thuế"]), ("quan_ly_thue_quoc_te", ["quản lý thuế quốc tế"]),
    ("khai_nop_thue", ["khai thuế", "nộp thuế"]),
]

# Weights of words in news titles and summaries.
NEWS_WEIGHTS = {
    "hộ kinh doanh": 3.0, "cá nhân kinh doanh": 3.0, "kinh doanh cá thể": 2.5, "thuế": 1.5, "thuế gtgt": 2.5, "thuế tncn": 2.5, "hóa đơn điện tử": 3.0,
    "máy tính tiền": 3.0, "doanh thu": 2.0, "kê khai": 2.0, "nộp thuế": 2.0, "thương mại điện tử": 2.0, "sàn thương mại điện tử": 2.5, "mã số thuế": 2.0,
    "định danh cá nhân": 2.5, "chậm nộp": 2.0, "xử phạt": 2.0, "lệ phí môn bài": 2.0, "thuế khoán": 2.5, "bỏ thuế khoán": 3.0,
}
NEWS_TOPICS = [
    ("e_invoice", ["hóa đơn điện tử", "máy tính tiền"]), ("household_business_tax", ["hộ kinh doanh", "cá nhân kinh doanh", "thuế khoán"]),
    ("tax_calculation", ["thuế gtgt", "thuế tncn"]), ("penalty", ["chậm nộp", "xử phạt"]), ("ecommerce_tax", ["thương mại điện tử", "sàn thương mại điện tử"]),
    ("tax_identification", ["mã số thuế", "định danh cá nhân"]),
]
TOPIC_KEYWORDS = {
    "e_invoice": ["hóa đơn điện tử", "máy tính tiền", "khởi tạo từ máy tính tiền", "sinh trắc học", "etax mobile"],
    "household_business_tax": ["hộ kinh doanh", "cá nhân kinh doanh", "thuế khoán", "bỏ thuế khoán", "kê khai", "nộp thuế điện tử", "doanh thu"],
    "ecommerce_tax": ["thương mại điện tử", "sàn thương mại điện tử", "gian lận thuế", "trục lợi thuế", "hoàn thuế", "dòng tiền"],
}
QUERY_TERMS = [
    "hộ kinh doanh", "cá nhân kinh doanh", "hóa đơn điện tử", "máy tính tiền", "khởi tạo từ máy tính tiền", "sinh trắc học", "thương mại điện tử",
    "sàn thương mại điện tử", "gian lận thuế", "trục lợi thuế", "thuế khoán", "bỏ thuế khoán", "kê khai", "nộp thuế điện tử",
]
QUERY_TOPICS = [
    ("e_invoice", ["hóa đơn điện tử", "máy tính tiền", "sinh trắc học"]),
    ("household_business_tax", ["hộ kinh doanh", "cá nhân kinh doanh", "thuế khoán", "bỏ thuế khoán"]),
    ("ecommerce_tax", ["thương mại điện tử", "sàn thương mại điện tử", "gian lận thuế", "trục lợi thuế"]),
]

# Words of link titles that are no news, and of those that are.
NEWS_IGNORED = [
    "trang chủ", "liên hệ", "sơ đồ", "đăng nhập", "english", "rss", "facebook", "youtube", "hỏi đáp về thuế", "tổ chức ngành thuế", "địa chỉ cơ quan thuế",
    "tin bài về thuế", "chính sách thuế", "ứng dụng hỗ trợ người nộp thuế",
]
NEWS_WANTED = [
    "hộ kinh doanh", "cá nhân kinh doanh", "hóa đơn điện tử", "máy tính tiền", "thuế khoán", "bỏ phương thức thuế khoán", "kê khai", "nộp thuế điện tử",
    "thương mại điện tử", "sàn thương mại điện tử", "mã số thuế", "định danh cá nhân", "doanh thu", "thuế gtgt", "thuế tncn", "xử phạt", "chậm nộp",
]

# What ends the content of a news page, lines that are no content, their beginnings, and hints of related news.
NEWS_ENDS = [
    "Thuế Việt Nam - Trang thông tin điện tử của Cục Thuế", "Cơ quan chủ quản: Bộ Tài chính", "Ghi rõ nguồn", "Bạn đã nhấn vào một liên kết",
    "gdt.gov.vn không chịu trách nhiệm", "Chức năng này đang được xây dựng",
]
NEWS_NOISE = ["Ứng dụng hỗ trợ người nộp thuế", "NGÀNH THUẾ COI TRỌNG, XÂY DỰNG VÀ GÌN GIỮ CÁC GIÁ TRỊ “MINH BẠCH – CHUYÊN NGHIỆP – LIÊM CHÍNH – ĐỔI MỚI\""]
NEWS_NOISE_STARTS = ["Địa chỉ:", "Điện thoại:", "Fax:"]
NEWS_RELATED = [
    "Cục Thuế gửi THƯ NGỎ", "Không tiếp tay cho các hành vi gian lận thuế", "Tăng cường phối hợp đào tạo liên ngành", "Mua bán hóa đơn giá trị gia tăng trái phép",
    "Bộ trưởng Ngô Văn Tuấn tiếp", "Báo chí và ngành Thuế Việt Nam:", "Bế giảng lớp bồi dưỡng", "Khẩn trương giải quyết vướng mắc", "Khai giảng lớp bồi dưỡng",
    "Tình hình thực hiện nhiệm vụ trọng tâm", "Sổ tay thuế cho hộ, cá nhân kinh doanh", "Kiểm soát doanh thu đa kênh", "Bản tin Thuế tuần",
]

# Misprints and what they stand for; the second list by pattern.
NEWS_TYPOS = [
    ("hóađơn", "hóa đơn"), ("mua bángiả", "mua bán giả"), ("cánhân", "cá nhân"), ("việctập trung", "việc tập trung"), ("mở rộngcác", "mở rộng các"),
    ("quản lývà", "quản lý và"), ("người nộpthuế", "người nộp thuế"), ("trướcthời hạn", "trước thời hạn"), ("truy thu,xử phạt", "truy thu, xử phạt"),
    ("hơn.Đặc biệt", "hơn. Đặc biệt"), ("thương mại điệntử", "thương mại điện tử"), ("khuế khoán", "thuế khoán"), ("hgân hàng", "ngân hàng"),
    ("lính vực", "lĩnh vực"), ("thương maị", "thương mại"), ("tuy nhiện", "tuy nhiên"),
]
NEWS_TYPO_FORMS = [
    (r"(?iu)hóa[\x{200B}\x{FEFF}\x{A0}]*đơn", "hóa đơn"), (r"(?iu)cá[\x{200B}\x{FEFF}\x{A0}]*nhân", "cá nhân"), (r"(?iu)thương mại[\x{200B}\x{FEFF}\x{A0}]*điện tử", "thương mại điện tử"),
    (r"(?imu)^hó Cục trưởng(?![\p{L}\p{N}_])", "Phó Cục trưởng"), (r"(?imu)^ục trưởng(?![\p{L}\p{N}_])", "Cục trưởng"), (r"(?iu)Phó C\s*\n\s*ục trưởng", "Phó Cục trưởng"),
]

# Boosts of a chunk for a question, each a condition and its weight. Names: q_* are the question's, others the
# chunk's; t and ti are its text and the title of its article in lower case.
BOOSTS = [
    ("q_dieu is not null and dieu = q_dieu", 0.35), ("q_dieu is not null and coalesce(dieu <> q_dieu, true)", -0.08),
    ("q_khoan is not null and khoan = q_khoan", 0.25), ("q_khoan is not null and dieu = q_dieu and khoan is null", 0.04),
    ("q_diem is not null and lower(diem) = lower(q_diem)", 0.10), ("loai_van_ban = q_loai", 0.05), ("chu_de = q_chu_de", 0.05),
    ("q_mien and contains(t, 'miễn tiền chậm nộp')", 0.25), ("q_mien and contains(ti, 'miễn tiền chậm nộp')", 0.30), ("q_mien and dieu = 16", 0.30),
    ("q_mien and dieu = 16 and khoan = 5", 0.40), ("q_mien and dieu = 21", -0.20),
    ("q_topic = 'nguong_doanh_thu' and ma_van_ban = '141_2026_ND_CP'", 2.0), ("q_topic = 'nguong_doanh_thu' and ma_van_ban = '68_2026_ND_CP'", 0.20),
    ("q_topic = 'nguong_doanh_thu' and contains(t, '01 tỷ đồng')", 0.50), ("q_topic = 'nguong_doanh_thu' and contains(t, '1 tỷ đồng')", 0.50),
    ("q_topic = 'nguong_doanh_thu' and contains(t, '1.000.000.000')", 0.50),
    ("q_topic = 'hoa_don_dien_tu' and ma_van_ban = '70_2025_ND_CP'", 0.25), ("q_topic = 'hoa_don_dien_tu' and (contains(t, 'hóa đơn điện tử') or contains(ti, 'hóa đơn điện tử'))", 0.20),
    ("q_topic = 'hoa_don_may_tinh_tien' and ma_van_ban = '70_2025_ND_CP'", 0.35), ("q_topic = 'hoa_don_may_tinh_tien' and (contains(t, 'máy tính tiền') or contains(ti, 'máy tính tiền'))", 0.25),
    ("q_topic = 'hoa_don_may_tinh_tien' and dieu = 11", 0.20),
    ("q_topic = 'ho_kinh_doanh' and ma_van_ban = '68_2026_ND_CP'", 0.10), ("q_topic = 'ho_kinh_doanh' and ma_van_ban = '141_2026_ND_CP'", 0.50),
    ("q_topic = 'tien_cham_nop_phat' and ma_van_ban = '18_2023_TT_BTC'", 0.30), ("q_topic = 'tien_cham_nop_phat' and (contains(t, 'chậm nộp phạt') or contains(t, 'tiền chậm nộp phạt'))", 0.25),
    ("q_amend and ma_van_ban = '141_2026_ND_CP'", 0.60), ("q_amend and contains(t, '01 tỷ đồng')", 0.30), ("q_amend and contains(t, '1 tỷ đồng')", 0.30), ("q_amend and contains(t, 'sửa đổi')", 0.20),
    ("q_amend and ma_van_ban = '141_2026_ND_CP'", 2.0), ("q_amend and contains(t, 'sửa đổi')", 0.50),
]
#: Boost of each exact phrase of the question in the text, and in the title.
PHRASE_BOOSTS = (0.08, 0.10)

# The topic in which a newer document replaces an older one, and both codes.
SUPERSEDES = ("nguong_doanh_thu", "141_2026_ND_CP", "68_2026_ND_CP")

# Places put first for questions on late payment, with their priority: article, clause (any if none).
LATE_PHRASE = "miễn tiền chậm nộp"
LATE_PRIORITY = [(16, 5, 100), (16, None, 80), (21, None, 20)]

# The labelled questions of the published evaluation.
BENCHMARK = [
    ("NR198_001", "Nghị quyết 198 quy định gì về hộ kinh doanh?", "Nghị quyết 198/2025/QH15", ["hộ kinh doanh"], "resolution"),
    ("NR198_002", "Nghị quyết 198 có định hướng gì đối với thuế khoán?", "Nghị quyết 198/2025/QH15", ["thuế khoán"], "resolution"),
    ("NR198_003", "Nghị quyết 198 có quy định gì về lệ phí môn bài?", "Nghị quyết 198/2025/QH15", ["lệ phí môn bài"], "resolution"),
    ("CROSS_004", "Doanh thu dưới 1 tỷ đồng thì nghĩa vụ thuế của hộ kinh doanh được quy định ở những văn bản nào?", None, ["Nghị định 68", "Nghị định 141"], "cross_document"),
    ("CROSS_005", "Hộ kinh doanh sử dụng hóa đơn điện tử cần tham khảo những văn bản nào?", None, ["Nghị định 70", "Thông tư 32"], "cross_document"),
    ("CROSS_006", "Khi chậm nộp thuế hoặc chậm nộp tiền phạt thì cần tham khảo những văn bản nào?", None, ["Luật quản lý thuế", "Thông tư 18"], "cross_document"),
]

# What replaces an answer that its context doesn't bear out, and an empty one.
GUARD_ANSWER = (
    "Context hiện tại chỉ cho biết nghĩa vụ khai/thông báo doanh thu và quy định về trường hợp phát sinh khai, nộp thuế khi vượt ngưỡng. "
    'Tôi chưa thấy quy định trực tiếp trong context để kết luận "không phải nộp thuế".'
)
EMPTY_ANSWER = "Hệ thống chưa tạo được câu trả lời từ dữ liệu hiện có."

# Forms of references to legal documents, in the order of their results.
REFERENCE_FORMS = [
    r"Luật\s+số\s+\d+/\d{4}/[A-ZĐ\-]+", r"Nghị định\s+số\s+\d+/\d{4}/NĐ-CP", r"Thông tư\s+số\s+\d+/\d{4}/TT-BTC", r"Công văn\s+số\s+\d+/[A-Z0-9\-]+",
    r"Quyết định\s+số\s+\d+/[A-Z0-9\-]+", r"\d+/\d{4}/NĐ-CP", r"\d+/\d{4}/TT-BTC", r"\d+/\d{4}/QH\d+",
]

# Order of the points of a clause.
POINT_ORDER = ["a", "b", "c", "d", "đ", "e", "g", "h", "i", "k", "l", "m", "n"]

# Names that a document may go by in an answer's sources.
DOCUMENT_ALIASES = {
    "Luật quản lý thuế 108/2025/QH15": ["108-2025-QH15", "Luật quản lý thuế 108/2025/QH15"],
    "Luật Thuế giá trị gia tăng 48/2024/QH15": ["48-2024-QH15", "Luật Thuế giá trị gia tăng 48/2024/QH15"],
    "Luật Thuế thu nhập cá nhân 109/2025/QH15": ["109-2025-QH15", "Luật Thuế thu nhập cá nhân 109/2025/QH15"],
    "Nghị quyết 198/2025/QH15": ["198-2025-QH15", "Nghị quyết 198/2025/QH15"],
    "68-2026-ND-CP": ["68-2026-ND-CP"],
    "70-2025-ND-CP": ["70-2025-ND-CP"],
    "Thông tư 18/2023/TT-BTC": ["18-2023-TT-BTC", "Thông tư 18/2023/TT-BTC"],
    "Thông tư 32/2025/TT-BTC": ["32-2025-TT-BTC", "Thông tư 32/2025/TT-BTC"],
}
